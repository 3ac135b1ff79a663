import random

import corpus_pipeline
from tabulon.llm import near_copies as near


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest ids of the components over all pairs with Jaccard similarity of at least 4/5."""
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if label[a] != label[b] and (5 * len(x & y) >= 4 * len(x | y)):
                label = [label[b] if v == label[a] else v for v in label]
    return {i: min(rows[k][0] for k in range(len(rows)) if label[k] == label[j]) for j, (i, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 60, 300]))]
        rows.append(base)
        for _ in range(rng.choice([1, 2, 12])):
            base = list(base if g % 3 else rows[-1])  # every third group is a chain
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                base[rng.randrange(len(base))] = f"w{rng.randrange(3000)}"
            rows.append(base)
    texts = [" ".join(x) for x in rows] + [None, "", " \n", "one", "One", "ONE two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_brute_force_jaccard(spark):
    rows = corpus(3)
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert dict(map(tuple, near.near_copies(df).collect())) == want
    kept = corpus_pipeline.simhash(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near.keep_one_copy(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a B c"), (4, "a b c"), (5, "A b c"), (None, "alone")], "doc_id long, text string")
    assert sorted(map(tuple, near.near_copies(df).collect()), key=repr) == sorted([(None, 4), (4, 4), (4, 4), (5, 4), (None, None)], key=repr)
    assert sorted((r.doc_id for r in near.keep_one_copy(df).collect()), key=repr) == [4, 4, None, None]
