import random
import re

import numpy as np
import pytest

from tabulon.llm import decontam
from tabulon.llm.decontam import find_benchmark, remove_benchmark, words_of
from tabulon.llm.fm_index import FmIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    wins = []
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        wins += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if w else []
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(found, key=repr)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 4, 300) if seed else np.tile([1, 2, 1, 2, 3], 60)
    index = FmIndex(seq, 5)
    for n in (1, 2, 3, 5):
        pats = np.unique(rng.integers(1, 6, (40, n)), axis=0)
        which, where = index.occurrences(pats)
        got = sorted(zip(which.tolist(), where.tolist(), strict=True))
        assert got == sorted((k, i) for k, p in enumerate(pats) for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all())
    sa = suffix_array(np.array([0, 2, 1, 0, 2, 1, 2, 0]))
    assert sorted(sa) == list(range(8))


def data():
    rng = random.Random(2)
    vocab = ["alpha", "Beta", "gÄmma", "del9", "eps", "zeta", "eta"]
    items = [(k, ", ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 25])))) for k in range(12)] + [(50, ""), (51, None), (52, "...")]
    docs = []
    for d in range(60):
        parts = [rng.choice(vocab + ["other", "THING"]) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items[:12])[1])
            at = rng.randint(0, len(parts))
            parts[at:at] = w if rng.random() < 0.5 else w[2:-1]
        docs.append((d, rng.choice([" ", "\n", "! "]).join(parts)))
    docs += [(7, items[5][1] + " other"), (7, items[5][1] + " other"), (7, "other"), (None, "no such"), (None, items[6][1] + "\n" + items[3][1])]
    return [*docs, (100, None), (101, ""), (None, items[3][1]), (102, "other " * 20000 + items[4][1])], items


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_against_brute_force(spark, block, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(decontam, "SHARD_WORDS", 500)
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, n_hit string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"], key=repr)) for r in find_benchmark(df, bench, block_words=block).collect()), key=repr)
    assert got == brute(docs, items)
    spans = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans)) for r in find_benchmark(df, bench, block_words=block).collect()]
    assert sorted(spans, key=repr) == sorted((x[:3] for x in brute(docs, items)), key=repr)
    clean = remove_benchmark(df, bench, block_words=block)
    assert clean.columns == df.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert all(n == 0 for _, _, n, _ in brute(left, items))
    hit = {d for d, _, n, _ in brute(docs, items) if n}
    assert sorted(((d, t) for d, t in left if d not in hit), key=repr) == sorted(((d, t) for d, t in docs if d not in hit), key=repr) and len(left) == len(docs)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_benchmark(df, none).select("n_words", "n_hit").collect() == [(2, 0)]
    assert find_benchmark(df.limit(0), none).count() == 0 and remove_benchmark(df, none).collect() == [(1, "a b")]
    assert words_of("Aé-B_c 9".encode()) == ["aé".encode(), b"b", b"c", b"9"]
