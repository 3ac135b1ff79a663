import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tabulon.llm.queries import ORACLE, QUERIES
from tabulon.llm.tokens import vocabulary_path

from . import test_decontam, test_line_dedup, test_near_copies, test_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    texts, labels = test_toxicity.documents(400, 11)
    shared = "This very line is shared by many of the documents of this test"
    passage = "the passage of the benchmark has more than ten words in it and is quoted as a whole"
    rows = []
    for k, t in enumerate(texts):
        if k % 7 == 1:
            t += "\n" + shared
        if k % 11 == 2:
            t = passage.title() + " " + t
        rows.append((k, t))
    rows += [(600 + k, rows[5][1]) for k in range(4)] + [(700, None), (701, ""), (702, passage)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [len(r[1] or "") for r in rows]}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(400)), "quality": [1] * 400, "toxic": labels}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [passage, ""]}), d / "benchmark.parquet")
    return str(d)


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == COLUMNS
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            wrong = [k for k in before if (k not in after) != (labels.get(k, 0) == 1)]
            assert set(after) <= set(before) and len(wrong) <= 40 and all(after[k] == before[k] for k in after)
        elif name == "line_dedup":
            assert after == {i: t for i, t, _, _ in test_line_dedup.brute(list(before.items()))}
        elif name == "simhash":
            assert sorted(after) == sorted(set(test_near_copies.brute(sorted(before.items())).values())) and all((after[k] or "") == (before[k] or "") for k in after)
        elif name == "decontamination":
            items = [(1, spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text)]
            assert set(after) == set(before)
            assert all(n == 0 for _, _, n, _ in test_decontam.brute(sorted(after.items()), items))
            assert all(after[d] == before[d] for d, _, n, _ in test_decontam.brute(sorted(before.items()), items) if n == 0)
        else:
            tok = Tokenizer.from_file(vocabulary_path())
            pieces = {}
            for r in out.collect():
                ids = np.array([*tok.encode(before[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
                pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            assert set(pieces) == set(before)
            assert all(sum(n for _, n, _ in p) == p[0][2] for p in pieces.values())
            return
        out.write.mode("overwrite").parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")


def test_run_and_registry(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[0] == "doc_id" and out.count() > 0
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
