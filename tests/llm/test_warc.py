import gzip
import io
import os
import random

import pytest

from tabulon.llm.warc import base32_sha1, read_archives, record, records_in, write_archives


def pages():
    rng = random.Random(3)
    same = "<p>same</p>"
    rows = [(k, f"http://h/{k} x\r\n", rng.choice([same, f"<p>é {k}</p>" * rng.randint(1, 400), "", None])) for k in range(60)]
    return [*rows, (None, None, same), (0, "again", rows[0][2]), (99, None, "z" * 3_000_000), (98, "u", "\x1f\x8b\x08 no member" * 50)]


def expected(rows, least=0):
    low = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= least:
            low[h or ""] = min(k, low.get(h or "", k))
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        first = low.get(h or "")
        revisit = first is not None and first != k
        out.append((None if k is None else str(k), len(p), base32_sha1(p), "revisit" if revisit else "response", str(first) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("split", "least"), [(700, 0), (8 << 20, 5)])
def test_round_trip(spark, tmp_path, split, least):
    rows = pages()
    df = spark.createDataFrame([(k, u, h, "x") for k, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    assert write_archives(df, folder, min_bytes=least, max_file=3_000) == len(rows)
    got = read_archives(spark, folder, split)
    assert sorted((tuple(r) for r in got.select("record_id", "payload_bytes", "payload_digest", "warc_type", "refers_to").collect()), key=repr) == expected(rows, least)
    assert {r.record_id: bytes(r.payload).decode() for r in got.filter("warc_type = 'response' and record_id is not null").collect()}["99"] == "z" * 3_000_000
    assert got.filter("record_id = '5'").first().target_uri in ("http://h/5%20x%0D%0A",)
    files = [f for f in os.listdir(tmp_path / "w") if f.endswith(".gz")]
    named = spark.read.parquet(f"{folder}/_manifest").collect()
    assert len(files) > 3 and sorted(os.path.basename(r.path) for r in named) == sorted(files)
    assert all(os.path.getsize(r.path.removeprefix("file://")) == r.bytes for r in named) and sum(r.records for r in named) == len(rows)
    assert gzip.open(tmp_path / "w" / files[0]).read(8) == b"WARC/1.1"


def test_without_broadcast_and_with_leftovers(spark, tmp_path):
    rows = [(k, "u", "<p>hot</p>" if k % 3 else f"<p>{k // 2 % 200}</p>") for k in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"file://{tmp_path}/w"
    assert write_archives(df, folder, max_broadcast=0) == len(rows)
    # what an attempt that was lost has left
    (tmp_path / "w" / "part-000000-0000-999.warc.gz").write_bytes(record(7, "u", b"half", base32_sha1(b"half"))[:30])
    got = read_archives(spark, folder, with_payload=False)
    assert sorted((tuple(r) for r in got.select("record_id", "payload_bytes", "payload_digest", "warc_type", "refers_to").collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("size", [1, 7, 100, 1000, 10**6])
def test_every_record_has_one_owner(size):
    rng = random.Random(size)
    parts, starts, at = [b"garbage \x1f\x8b\x08 in front"], [], 0
    for k in range(25):
        at = sum(map(len, parts))
        starts.append(at)
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 900)))
        # random bytes hardly compress: magic numbers may stand in the stored data
        parts.append(record(k, "u", body + b"\x1f\x8b\x08" * 3, base32_sha1(body)))
    whole = b"".join(parts)
    step = max(size, 1) if size >= 100 else 500 + size
    found = [x for a in range(0, len(whole), step) for x, _ in records_in(io.BytesIO(whole), a, min(a + step, len(whole)))]
    assert found == starts


def test_damage_and_empty(spark, tmp_path):
    bad = record(1, "u", b"payload" * 100, base32_sha1(b"payload" * 100))
    whole = bad[:60] + record(2, "u", b"", base32_sha1(b"")) + gzip.compress(b"no record") + bad
    assert [f["warc-record-id"] for _, f in records_in(io.BytesIO(whole), 0, len(whole))] == ["<urn:page:2>", "<urn:page:1>"]
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert write_archives(df, f"file://{tmp_path}/e") == 0 and read_archives(spark, f"file://{tmp_path}/e").count() == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.warc.gz").write_bytes(record(3, "u", b"other", base32_sha1(b"payload")))
    with pytest.raises(Exception, match="digest"):
        read_archives(spark, f"file://{tmp_path}/f").collect()
