"""WARC archives in a shared folder: a writer with revisit records, and a reader that splits gzip files.

Each record is a gzip member of its own. The reader gets byte ranges: a task looks for the gzip magic from the start of its range, decodes the
head of each candidate, takes it as a record only if a WARC header comes out, and owns the records that start
inside the range, whatever their length. Files are reached through pyarrow.fs, so the folder may be of any kind that all executors see.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, cut, quoted, small_batches

MAGIC = b"\x1f\x8b\x08"
MAX_FILE = 256 << 20
SPLIT = 8 << 20
CHUNK = 1 << 20
BROADCAST_BYTES = 32 << 20  # of repeated digests, at 64 a digest
HEAVY = 256
MANIFEST, FILES = "_manifest", "path string, bytes long, records long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("offset", T.LongType()), ("warc_type", T.StringType()), ("record_id", T.StringType()), ("target_uri", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _urn(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _key(urn: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:(.*)>", urn or "")
    return m[1] or None if m else None


def record(key, uri: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit has the HTTP head (with the payload's length), and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def _write(folder: str, max_file: int):
    """Writes what a task gets; a row (path, bytes, records) per file. Names hold the attempt's number, so attempts never touch each other's files."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        scheme = folder[: folder.index(root)] if root in folder else ""
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        out, files = None, []

        for b in small_batches(batches):
            keys, uris, digests, firsts = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            for key, uri, payload, digest, first in zip(keys, uris, binary(b, 2), digests, firsts, strict=True):
                if out is None or files[-1][1] >= max_file:
                    if out is not None:
                        out.close()
                    files.append([f"{root}/part-{part:06d}-{len(files):04d}-{attempt}.warc.gz", 0, 0])
                    out = fs.open_output_stream(files[-1][0], compression=None)
                data = record(key, uri, payload, base64.b32encode(digest).decode(), first, first is not None)
                out.write(data)
                files[-1][1] += len(data)
                files[-1][2] += 1
        if out is not None:
            out.close()
            paths, sizes, counts = zip(*files, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([scheme + x for x in paths]), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"])

    return run


def _referred(rows: DataFrame, firsts: DataFrame, max_broadcast: int) -> DataFrame:
    """rows with the first key of their payload (null where that is their own, or none is). firsts: (digest, first, n) of payloads that come twice or more.

    While firsts is small it goes to all tasks, and no payload is shuffled. Beyond, so do the digests that hold over a HEAVY-th of all repeated rows, which are
    fewer than HEAVY whatever the table; the other rows meet their first by digest, so that no task gets more than such a part of them.
    """
    told, total = firsts.agg(F.count("*"), F.sum("n")).first()
    own = F.col("first").eqNullSafe(F.col("key"))
    if not told:
        return rows.withColumn("first", F.lit(None).cast(rows.schema["key"].dataType))
    if told * 64 <= max_broadcast:
        found = rows.join(F.broadcast(firsts.drop("n")), "digest", "left")
    else:
        heavy = firsts.filter(F.col("n") * HEAVY > total).drop("n")
        often = rows.join(F.broadcast(heavy), "digest", "left")
        rest = firsts.filter(F.col("n") * HEAVY <= total).drop("n")
        found = often.filter("first is not null").unionByName(often.filter("first is null").drop("first").join(rest, "digest", "left"))
    return found.withColumn("first", F.when(~own, F.col("first")))


def write_archives(df: DataFrame, folder: str, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, max_file: int = MAX_FILE, max_broadcast: int = BROADCAST_BYTES) -> int:
    """A record per row of df, in folder (a URI of a shared file system); the number of records.

    Of equal payloads (UTF-8; null is empty) of at least min_bytes, the smallest key is written as response, the
    others as revisit of it; all others are responses. Rows that repeat the smallest key are responses too. A null key: its record
    has no number; it is a revisit if a key is there to refer to. A null uri is empty. Nothing is written for an empty table. Extra columns are ignored.

    Digests and smallest keys are aggregated without the payloads. MANIFEST, a Parquet table in the folder, names the files of those task attempts that
    Spark committed; files that lost attempts leave behind aren't in it, and the reader passes them over.
    """
    spark = df.sparkSession
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = df.select(quoted(key_col).alias("key"), quoted(uri_col).cast("string").alias("uri"), F.coalesce(quoted(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    firsts = cut(rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"))
    marked = _referred(rows, firsts, max_broadcast).select(F.col("key").cast("string"), "uri", "payload", "digest", F.col("first").cast("string"))
    marked.mapInArrow(_write(folder, max_file), FILES).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return spark.read.schema(FILES).parquet(f"{folder}/{MANIFEST}").agg(F.sum("records")).first()[0] or 0


class _Window:
    """A file read on from some offset, with what is still needed held."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, bytearray()
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(CHUNK)
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        """Forgets what lies before, a chunk or more at a time."""
        if upto - self.base >= CHUNK:
            del self.data[: upto - self.base]
            self.base = upto


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at this offset, if it is a WARC record."""
    pos = at - w.base
    while len(w.data) - pos < 512 and w.more():
        pass
    d, out = zlib.decompressobj(31), []
    try:
        # the head alone first: most candidates fail there
        if not zlib.decompressobj(31).decompress(w.data[pos : pos + 512], 7).startswith(b"WARC/1."):
            return None
        while not d.eof:
            if pos >= len(w.data) and not w.more():
                return None
            piece = w.data[pos : pos + 65536]
            out.append(d.decompress(piece))
            pos += len(piece) - len(d.unused_data)
    except zlib.error:
        return None
    return b"".join(out), w.base + pos


def _parse(raw: bytes) -> dict | None:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    try:
        block = rest[: int(fields["content-length"])]
    except (KeyError, ValueError):
        return None
    return fields | {"block": block}


def records_in(file, start: int, end: int):
    """(offset, fields) of the records that start in [start, end)."""
    w, at = _Window(file, start), start
    while True:
        found = w.data.find(MAGIC, at - w.base)
        if found < 0:
            at = max(at, w.base + len(w.data) - 2)
            w.drop(at)
            if at >= end or not w.more():
                return
            continue
        at = w.base + found
        if at >= end:
            return
        w.drop(at)
        got = _member(w, at)
        fields = _parse(got[0]) if got else None
        if fields is None:
            at += 1
            continue
        yield at, fields
        at = got[1]


def _read(with_payload: bool):
    def run(batches):
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for at, x in records_in(f, start, end):
                        http, _, payload = x["block"].partition(b"\r\n\r\n")
                        told = x.get("warc-payload-digest", "").removeprefix("sha1:")
                        revisit = x.get("warc-type") == "revisit"
                        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        size = int(m[1]) if revisit and m else len(payload)
                        digest = told if revisit else base32_sha1(payload)
                        if not revisit and told and told != digest:
                            raise ValueError(f"{path} at {at}: the payload's digest is {digest}, its header says {told}")
                        rows.append((path, at, x.get("warc-type"), _key(x.get("warc-record-id")), x.get("warc-target-uri") or None, size, digest, _key(x.get("warc-refers-to")), payload if with_payload and not revisit else None))
                        held += len(payload)
                        if held > 8e6 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], RECORD_SCHEMA.fieldNames())


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives in folder: RECORD_SCHEMA. payload is null for revisits (and without with_payload);
    payload_bytes and payload_digest are those of the full payload. Each response's payload is held against its digest.
    A folder with a manifest: the files that it names; without one: all *.warc.gz in it, in the order of their names.
    Bytes that are no record are passed over; a folder that is empty or absent gives no rows."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.Directory:
        files = spark.read.schema(FILES).parquet(f"{folder}/{MANIFEST}").select("path", "bytes")
    else:
        scheme = folder[: folder.index(root)] if root in folder else ""
        found = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".warc.gz")]
        files = spark.createDataFrame([(scheme + f.path, f.size) for f in found], "path string, bytes long")
    files = files.filter("bytes > 0")
    whole = files.agg(F.sum("bytes")).first()[0] or 0
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    splits = files.select("path", "bytes", start).select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    # small files share tasks
    return splits.repartition(max(1, -(-whole // split_bytes))).mapInArrow(_read(with_payload), RECORD_SCHEMA)
