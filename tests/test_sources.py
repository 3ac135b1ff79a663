import logging

import pytest

import __spark_entry__ as entry
from tabulon.sources.store import S3Loader, extension, init_logger, load, s3_options, save, write_bytes
from tabulon.streaming.windows import windowed_statistics


@pytest.mark.parametrize("ext", ["csv", "json", "parquet"])
def test_round_trip(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "a"), (2, "b,c")], "n int, `s.q0.5` string")
    path = str(tmp_path / f"t.{ext}")
    save(df, path)
    assert sorted(tuple(r) for r in load(spark, path).select("n", "`s.q0.5`").collect()) == [(1, "a"), (2, "b,c")]


def test_json_of_many_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"n": 1},\n {"n": 2}\n]\n')
    assert sorted(r.n for r in load(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    (tmp_path / "b.json").write_text('[{"n": 1}, {"n": 2}]')
    assert sorted(r.n for r in load(spark, str(tmp_path / "b.json")).collect()) == [1, 2]


def test_bytes_through_the_file_system(spark, tmp_path):
    path = tmp_path / "x.bin"
    for content in (b"\x00\xffab", b""):
        write_bytes(spark, f"file://{path}", content)
        assert path.read_bytes() == content


def test_spreadsheet(spark, tmp_path):
    pytest.importorskip("openpyxl")
    path = f"file://{tmp_path / 't.xlsx'}"
    save({"one": spark.createDataFrame([(1, "a")], "n int, s string"), "two": spark.range(2)}, path, index=False)
    assert [tuple(r) for r in load(spark, path).collect()] == [(1, "a")]


def test_certificates_are_checked(caplog):
    assert not any("ssl.channel" in k for k in s3_options(verify=False)) and "checked all the same" in caplog.text
    assert s3_options(verify="/etc/trust.jks")["spark.executor.extraJavaOptions"].endswith("=/etc/trust.jks")


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}', '{"a":1}')], "geometry string, properties string")
    save(df, str(tmp_path / "f.geojson"))
    (tmp_path / "g.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": 1}}]}')
    r = load(spark, str(tmp_path / "g.geojson")).first()
    assert '"coordinates"' in r.geometry and r.properties.replace(" ", "") == '{"a":1}'


def test_refusals(spark):
    for bad in ("x.pkl", "x.txt"):
        with pytest.raises(ValueError):
            extension(bad, ("csv",))
    with pytest.raises(ValueError):
        S3Loader("other")
    with pytest.raises(ValueError):
        save({"a": spark.range(1)}, "x.csv")


def test_options(monkeypatch, tmp_path):
    monkeypatch.setenv("AWS_S3_ENDPOINT", "https://store.example.org")
    monkeypatch.setenv("AWS_SESSION_TOKEN", "t")
    o = s3_options(access_key="a", secret_key="b")
    assert o["spark.hadoop.fs.s3a.endpoint"] == "https://store.example.org" and o["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "true"
    init_logger(str(tmp_path / "logs" / "x.log")).info("hello")
    assert "hello" in (tmp_path / "logs" / "x.log").read_text()
    root = logging.getLogger()
    for h in list(root.handlers):
        root.removeHandler(h)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", "k", float(h + m)) for h in range(3) for m in (1, 30)], "ts string, k string, v double").selectExpr("cast(ts as timestamp) ts", "k", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_statistics(stream, "ts", "1 hour", ["v"], ["k"], late="1 hour").writeStream.outputMode("complete").format("memory").queryName("windows_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows_out").collect())) == sorted(map(tuple, windowed_statistics(df, "ts", "1 hour", ["v"], ["k"]).collect()))


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
