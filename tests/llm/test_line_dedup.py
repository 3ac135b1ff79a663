import hashlib
import random

import pytest

from tabulon.llm.line_dedup import drop_shared_lines, line_key, suspected_lines


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    shared = [("Shared line %d é with quite enough characters in it to count" % k)[: 40 + k] for k in range(6)]
    rows = []
    for i in range(80):
        lines = [f"own line {i} {j} " * 5 for j in range(3)] + [rng.choice(["\t", "", " "]) + rng.choice(shared).upper().replace("É", "é") + " \r" for _ in range(rng.randint(0, 4))] + ["short", ""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (None, shared[0]), (None, None), (102, "x" * 200_000), (3, rows[3][1])]


@pytest.mark.parametrize("limits", [{}, {"max_keys": 0}, {"max_filter_bits": 1}, {"max_filter_bits": 1, "max_keys": 0}, {"max_filter_bits": 1, "max_suspects": 0}, {"max_filter_bits": 1, "max_suspects": 0, "max_keys": 0}])
def test_against_brute_force(spark, limits):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "a", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_lines string, extra int").repartition(5)
    out = drop_shared_lines(df, **limits)
    assert out.columns == ["doc_id", "text", "n_lines", "extra", "_n_lines", "n_dropped"]
    assert sorted(((r[0], r[1], r[4], r[5]) for r in out.collect()), key=repr) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert drop_shared_lines(df).collect() == [(1, "", 1, 0)]
    assert drop_shared_lines(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("limits", [{}, {"max_filter_bits": 1}, {"max_filter_bits": 1, "max_suspects": 0}])
def test_only_suspected_repeats_are_shuffled(spark, limits):
    rng = random.Random(8)
    twice = [f"line {k} of two documents, long enough to count as one" for k in range(50)]
    rows = [(i, "\n".join([*(f"own line {i} {j} of one document, with some more words" for j in range(200)), *rng.sample(twice, 3)])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    got = [(bytes(r.digest), r.id) for r in suspected_lines(df, **limits).collect()]
    lines = {}
    for i, t in rows:
        for x in t.encode().split(b"\n"):
            lines.setdefault(hashlib.md5(line_key(x)).digest(), set()).add(i)
    repeats = {(d, i) for d, held in lines.items() if len(held) > 1 for i in held}
    assert repeats <= set(got) and len(got) == len(set(got)) <= len(repeats) + 20  # of 12,180 lines
