import random

import pytest
from tokenizers import Tokenizer

from tabulon.llm.token_spans import count_field_tokens, count_line_tokens
from tabulon.llm.tokens import vocabulary_path

TEXTS = [None, "", "\n", "one line", "a\n\nb\n", "Été à la mer.\n\n\n  Über — 漢字漢字\nend 😀😀\n", "x  \n y\n\n", "word " * 20_000 + "\n" + "é" * 50]


def brute(text, rule, bounds=None):
    t = text or ""
    tok = Tokenizer.from_file(vocabulary_path())
    raw = t.encode()
    if bounds is None:
        bounds, at = [], 0
        for line in t.split("\n"):
            bounds.append((at, at + len(line.encode()) + 1))
            at += len(line.encode()) + 1
        bounds[-1] = (bounds[-1][0], len(raw))
    counts, crossing, at = [0] * len(bounds), 0, 0
    from tabulon.llm.tokens import byte_alphabet

    alphabet = byte_alphabet()
    for piece in tok.encode(t, add_special_tokens=False).tokens:
        n = len([alphabet[c] for c in piece])
        where = [k for k, (a, b) in enumerate(bounds) if a < at + n and at < b]
        crossing += len(where) > 1

        def chars(k, lo=at, hi=at + n):
            a, b = bounds[k]
            return sum((x & 0xC0) != 0x80 for x in raw[max(a, lo) : min(b, hi)])

        k = where[0] if rule == "start" else where[-1] if rule == "end" else max(where, key=lambda k: (chars(k), -k))
        counts[k] += 1
        at += n
    return sum(counts), counts, crossing


@pytest.mark.parametrize("rule", ["majority", "start", "end"])
def test_lines(spark, rule):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in count_line_tokens(df, vocabulary_path(), rule=rule).collect()}
    assert got == {k: brute(t, rule) for k, t in enumerate(TEXTS)}


def test_spans_and_fields(spark):
    text = TEXTS[5]
    df = spark.createDataFrame([(1, text, "x"), (2, None, None)], "id long, a string, b string")
    r = {x[0]: x for x in count_line_tokens(df, vocabulary_path(), "id", "a", with_spans=True).collect()}
    spans = r[1]["spans"]
    assert [s.start for s in spans][0] == 0 and spans[-1].end == len(text) and all(a.end == b.start for a, b in zip(spans, spans[1:], strict=False))
    assert [sum(s.section == k for s in spans) for k in range(len(r[1].section_tokens))] == r[1].section_tokens
    rng = random.Random(1)
    rows = [(k, *("".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 9))) or None for _ in range(3))) for k in range(30)]
    f = spark.createDataFrame(rows, "id long, a string, b string, c string")
    got = {x[0]: tuple(x[1:]) for x in count_field_tokens(f, ["a", "b", "c"], vocabulary_path(), "id", rule="end").collect()}
    for k, *parts in rows:
        at, bounds = 0, []
        for p in parts:
            bounds.append((at, at + len((p or "").encode())))
            at = bounds[-1][1]
        assert got[k] == brute("".join(p or "" for p in parts), "end", bounds)
    with pytest.raises(ValueError):
        count_line_tokens(df, vocabulary_path(), "id", "a", rule="never")
    assert count_line_tokens(df.limit(0), vocabulary_path(), "id", "a").count() == 0
