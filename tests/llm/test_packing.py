import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabulon.llm.packing import VectorPacker, pack_texts, sequence_fill
from tabulon.llm.tokens import ChunkEncoder, vocabulary_path


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary_path())


def test_chunks_encode_like_whole_texts(plain):
    texts = ["", " ", "  ", "a  b", "x\n \ny", "a\n", "a\n ", "\t a", " a b ", "It's 12 o'clock.\n\nNow  then", "é  ü", "a<|endoftext|> b", "été où\r\n là", "tail \n", "  x", "1 22 333", " \n \n "]
    enc = ChunkEncoder(vocabulary_path(), limit=5)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("limits", [(64, 8, None, 7), (64, 3, 20, 16), (8, 1, 8, 4), (100, 50, 10, 30)])
def test_packer_respects_limits_and_covers_all(limits):
    rng = np.random.default_rng(1)
    p = VectorPacker(*limits)
    tokens = [int(x) for x in rng.integers(1, 300, 200)]
    loss = [int(rng.integers(0, t + 1)) for t in tokens]
    pieces = [x for k in range(200) for x in p.add(k, tokens[k], loss[k])] + list(p.place(last=True))
    seen = {k: [] for k in range(200)}
    seqs = {}
    for item, start, n, seq, offset in pieces:
        assert n > 0
        seen[item].append((start, n))
        seqs.setdefault(seq, []).append((offset, n, item, start))
    for k, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == tokens[k]
    most, segments, losses = limits[0], limits[1], limits[2] or limits[0]
    for parts in seqs.values():
        at = 0
        for offset, n, _, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= most and len(parts) <= segments
        assert sum(max(0, min(s + n, tokens[k]) - max(s, tokens[k] - loss[k])) for _, n, k, s in parts) <= losses


def test_pack_texts(spark, plain):
    texts = [None, "", "short one", "word " * 5000, "word " * 5000, "It was é long. " * 300, "end\n"]
    df = spark.createDataFrame([(k if k != 5 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, offset string")
    rows = pack_texts(df, vocabulary_path()).collect()
    ids = {(k if k != 5 else None): np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in enumerate(texts)}
    got = {}
    for r in rows:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, whole in ids.items():
        at = 0
        for start, n in sorted(got[k]):
            assert start == at
            at += n
        assert at == len(whole)
    assert sequence_fill(pack_texts(df, vocabulary_path())).filter("padding > 0 or tokens > 2048").count() == 0
    assert pack_texts(df.limit(0), vocabulary_path()).count() == 0
