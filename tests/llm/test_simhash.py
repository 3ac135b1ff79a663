import random

import numpy as np
import pytest
import xxhash

from tabulon.llm.simhash import GrayIndex, components, cover, fingerprint, gray_rank, keep_one, link_fingerprints, near_duplicates


def plain(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius=2):
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(prints))]


def cluster(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        p = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        out.append(p)
    return sorted(set(out))


def test_fingerprint_and_rank(spark):
    for t in ["", " \n", "one", "One two", "A b C d e f a b c", "x\x0by " * 5000, "é Ä ö"]:
        assert fingerprint(t.encode()) == plain(t)
    r = gray_rank(np.array([0, 1, 3, 2, 6, 1 << 63], np.uint64))
    assert r[:5].tolist() == [0, 1, 2, 3, 4] and r[5] == (1 << 64) - 1


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_all_within_the_radius(seed):
    codes = np.array(cluster(700, seed), np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    found = {(int(a), int(b)) for q, e, _ in GrayIndex(codes).search(codes, 2) for a, b in zip(q, e, strict=True)}
    d = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert found == set(map(tuple, np.argwhere(d <= 2).tolist()))


def test_cover_holds_each_code_once():
    rng = np.random.default_rng(1)
    sample = np.r_[rng.integers(0, 1 << 63, 500).astype(np.uint64), np.arange(500, dtype=np.uint64)]
    patterns, masks = cover(sample, 64)
    codes = np.r_[sample, rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)]
    assert (((codes[:, None] ^ patterns) & masks == 0).sum(axis=1) == 1).all()
    inside = ((sample[:, None] ^ patterns) & masks == 0).sum(axis=0)
    assert inside.max() <= 16


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102), (102, 100)] + [(-5, 200 + k) for k in range(30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100, -5: -5, **{200 + k: -5 for k in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_against_brute_force(spark):
    codes = cluster(900, 9)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = link_fingerprints(spark.createDataFrame([(c,) for c in signed], "fp long"), node_rows=50)
    roots = dict(map(tuple, components(edges).collect()))
    expected = groups(codes)
    by = {}
    for c, g in zip(signed, expected, strict=True):
        by.setdefault(g, set()).add(roots.get(c, c))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_documents(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["red", "Blue", "green", "old", "new"]) + str(rng.randrange(99)) for _ in range(400))
    texts = [(1, long), (2, long.upper()), (3, long + " tail"), (4, None), (5, ""), (6, "other words here entirely"), (None, long), (None, "alone null"), (2, long), (9, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "q") for i, t in texts], "doc_id long, text string, component_id string").repartition(3)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)
    prints = [plain(t) for _, t in texts]
    g = groups(prints)
    low = {r: min((i for (i, _), x in zip(texts, g, strict=True) if x == r and i is not None), default=None) for r in set(g)}
    assert got == sorted(((i, f"{p:016x}", low[r]) for (i, _), p, r in zip(texts, prints, g, strict=True)), key=repr)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted(i for (i, _), r in zip(texts, g, strict=True) if i is not None and low[r] == i)
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0
