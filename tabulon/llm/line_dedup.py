"""Removal of lines that many documents share.

Two Bloom filters hold the hashes of line keys: one those seen once, one those seen twice. Only lines that the
second filter holds are suspected repeats; only they are shuffled, for exact counting by the whole key.

* Both filters have the same number of slots, from the bytes of the table, so their load is alike at every size. They
  are built in segments: each task sends the slots that it set in either filter, the owner of a segment joins them
  (a slot set in "once" by two tasks is set in "twice"). No false negatives arise: a key of two documents sets its
  slots twice.
* The "twice" filter goes to all tasks if it has MAX_FILTER_BITS slots at most. Beyond, tasks send the 8-byte hashes of their distinct
  lines to the owners of the segments, where each is held against its segment's two filters. What comes back are the hashes of
  suspected repeats, which go to all tasks if they are MAX_SUSPECTS at most; beyond, (hash, digest, id) of the candidates
  meet them in a semi-join. Whole lines are never shuffled but for suspected ones.
* The confirmed keys go to all tasks if they are MAX_KEYS at most; beyond, the
  documents meet their lost lines in a join by id.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, cut, fresh, held, quoted, small_batches

MIN_CHARS, MIN_DOCS = 40, 5
SLOTS_PER_LINE = 4  # for lines of MIN_CHARS; usual lines are several times longer and get as many more
SEGMENT_BITS = 22
MAX_FILTER_BITS = 1 << 29  # 64 MB
MAX_SUSPECTS = 4_000_000  # 32 MB of hashes
MAX_KEYS = 500_000
BLANK = b" \t\n\x0b\x0c\r"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def line_key(line: bytes) -> bytes:
    """Stripped of [\\x20\\x09-\\x0D] and with A-Z lower-cased (bytes.lower leaves all other bytes alone)."""
    return line.strip(BLANK).lower()


def candidate(key: bytes, min_chars: int) -> bool:
    """Whether the key has min_chars code points, counted only if its bytes leave that open."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if candidate(k, min_chars)}


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple((hashes * odd) >> np.uint64(64 - bits) for odd in _ODD)


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _segments(slots: list[np.ndarray]):
    """The slots that one task set, by segment: offsets set once at least, and those set twice."""
    once, counts = np.unique(np.concatenate(slots), return_counts=True)
    seg = (once >> np.uint64(SEGMENT_BITS)).astype(np.int64)
    off = (once & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.uint32)
    cuts = np.flatnonzero(np.diff(seg)) + 1
    firsts = seg[np.r_[0, cuts]] if len(seg) else []
    rows = [(int(s), o.tobytes(), o[c > 1].tobytes()) for s, o, c in zip(firsts, np.split(off, cuts), np.split(counts, cuts), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["seg", "once", "twice"])


def _fill(text_at: int, bits: int, min_chars: int):
    def run(batches):
        found, n = [], 0
        for b in small_batches(batches):
            for text in binary(b, text_at):
                if keys := _keys(text, min_chars):
                    # a slot counts once for a document, so that its own repeats raise no suspicion
                    found.append(np.unique(np.concatenate(_slots(_hashes(keys), bits))))
                    n += len(found[-1])
            if n > 4_000_000:
                yield _segments(found)
                found, n = [], 0
        if found:
            yield _segments(found)

    return run


def _join_segment(t: pa.Table) -> pa.Table:
    once, twice = (np.zeros(1 << SEGMENT_BITS, bool) for _ in range(2))
    for a, b in zip(t.column("once").to_pylist(), t.column("twice").to_pylist(), strict=True):
        a = np.frombuffer(a, np.uint32)
        twice[a[once[a]]] = True
        once[a] = True
        twice[np.frombuffer(b, np.uint32)] = True
    return pa.table({"seg": [t.column("seg")[0].as_py()], "bits": pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())})


def _send(text_at: int, bits: int, min_chars: int):
    """Rows (seg, once, twice): hashes of lines that a task has in one of its documents, and in several, by the segment of their first slot."""

    def batch(held: list[np.ndarray]):
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        seg = (_slots(hashes, bits)[0] >> np.uint64(SEGMENT_BITS)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, hashes, counts = seg[order], hashes[order], counts[order]
        cuts = np.flatnonzero(np.diff(seg)) + 1
        rows = [(int(s), h.tobytes(), h[c > 1].tobytes()) for s, h, c in zip(seg[np.r_[0, cuts]], np.split(hashes, cuts), np.split(counts, cuts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["seg", "once", "twice"])

    def run(batches):
        found, n = [], 0
        for b in small_batches(batches):
            for text in binary(b, text_at):
                if keys := _keys(text, min_chars):
                    found.append(np.unique(_hashes(keys)))
                    n += len(found[-1])
            if n > 2_000_000:
                yield batch(found)
                found, n = [], 0
        if found:
            yield batch(found)

    return run


def _suspect(bits: int):
    """The hashes of a segment whose slots are both in its filter of those seen twice. The second slot is taken from the low bits, so that it lies in the segment."""

    def run(t: pa.Table) -> pa.Table:
        low = np.uint64((1 << SEGMENT_BITS) - 1)
        once, twice = (np.zeros(1 << SEGMENT_BITS, bool) for _ in range(2))

        def slots(data: bytes) -> list[np.ndarray]:
            h = np.frombuffer(data, np.uint64)
            return [_slots(h, bits)[0] & low, _slots(h, bits)[1] & low]

        chunks, again = t.column("once").to_pylist(), t.column("twice").to_pylist()
        for a, b in zip(chunks, again, strict=True):
            mine = np.unique(np.concatenate(slots(a)))
            twice[mine[once[mine]]] = True
            once[mine] = True
            twice[np.concatenate(slots(b))] = True
        found = [np.zeros(0, np.uint64)]
        for a in chunks:
            p, q = slots(a)
            found.append(np.frombuffer(a, np.uint64)[twice[p] & twice[q]])
        return pa.table({"h": pa.array(np.unique(np.concatenate(found)).view(np.int64))})

    return run


def _unpacked(segments: dict[int, bytes], bits: int) -> np.ndarray:
    """The filter as packed bits."""
    flat = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    size = (1 << SEGMENT_BITS) // 8
    for seg, data in segments.items():
        flat[seg * size : (seg + 1) * size] = np.frombuffer(zlib.decompress(data), np.uint8)
    return flat


def _lines(bits: int, min_chars: int, sent):
    """Distinct candidate keys of each document that the filter, or the sorted array of suspected hashes, holds."""

    def run(batches):
        known = held(sent.value["id"], lambda: _unpacked(sent.value["segments"], bits)) if bits else sent.value
        for b in small_batches(batches, keep=True):
            keys, rows = [], []
            for k, text in enumerate(binary(b, 1)):
                found = _keys(text, min_chars)
                keys += found
                rows += [k] * len(found)
            if not keys:
                continue
            hashes = _hashes(keys)
            if bits:
                hit = np.ones(len(keys), bool)
                for s in _slots(hashes, bits):
                    hit &= (known[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
            else:
                hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(keys), bool)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(pa.array(rows, pa.int64()))], ["key", "id"]).filter(pa.array(hit))

    return run


def _digests(min_chars: int):
    """(hash, digest, id) of each document's distinct candidate keys."""

    def run(batches):
        for b in small_batches(batches):
            keys, rows = [], []
            for k, text in enumerate(binary(b, 1)):
                found = _keys(text, min_chars)
                keys += found
                rows += [k] * len(found)
            digests = [hashlib.md5(x, usedforsecurity=False).digest() for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(keys).view(np.int64)), pa.array(digests, pa.binary()), b.column(0).take(pa.array(rows, pa.int64()))], ["h", "digest", "id"])

    return run


def suspected_lines(slim: DataFrame, min_chars: int = MIN_CHARS, max_filter_bits: int = MAX_FILTER_BITS, max_suspects: int = MAX_SUSPECTS) -> DataFrame:
    """(digest, id, and key or null) for each line of slim (id, text) that may stand in two documents; the three ways give all such lines, and few others."""
    spark, id_field = slim.sparkSession, T.StructField("id", slim.schema["id"].dataType)
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(SEGMENT_BITS, int(size / (min_chars + 1) * SLOTS_PER_LINE).bit_length())
    row = T.StructType([T.StructField("key", T.BinaryType()), id_field])
    whole = (F.unhex(F.md5("key")).alias("digest"), "id", "key")
    if 1 << bits <= max_filter_bits:
        segments = slim.mapInArrow(_fill(1, bits, min_chars), "seg long, once binary, twice binary").groupBy("seg").applyInArrow(_join_segment, "seg long, bits binary")
        sent = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "segments": {r[0]: bytes(r[1]) for r in segments.collect()}})
        return slim.mapInArrow(_lines(bits, min_chars, sent), row).select(*whole)
    found = cut(slim.mapInArrow(_send(1, bits, min_chars), "seg long, once binary, twice binary").groupBy("seg").applyInArrow(_suspect(bits), "h long"))
    if found.count() <= max_suspects:
        sent = spark.sparkContext.broadcast(np.sort(found.toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)))
        return slim.mapInArrow(_lines(0, min_chars, sent), row).select(*whole)
    small = T.StructType([T.StructField("h", T.LongType()), T.StructField("digest", T.BinaryType()), id_field])
    return slim.mapInArrow(_digests(min_chars), small).join(found, "h", "left_semi").select("digest", "id", F.lit(None).cast("binary").alias("key"))


def _apply(id_at: int, text_at: int, min_chars: int, sent, lost_at: int | None, schema_at: list[int], names: list[str], out_types):
    """Drop lines: those whose key's digest is among the confirmed ones (kept by another id), or in the row's own list."""

    def run(batches):
        keep = sent.value if sent is not None else None
        for b in small_batches(batches):
            ids = b.column(id_at).to_pylist()
            losses = b.column(lost_at).to_pylist() if lost_at is not None else None
            texts, n_lines, n_dropped = [], [], []
            for k, text in enumerate(binary(b, text_at)):
                lines = text.split(b"\n")
                own = frozenset(losses[k] or ()) if losses is not None else None
                left = []
                for line in lines:
                    key = line_key(line)
                    if candidate(key, min_chars):
                        digest = hashlib.md5(key, usedforsecurity=False).digest()
                        if digest in own if keep is None else digest in keep and keep[digest] != ids[k]:
                            continue
                    left.append(line)
                texts.append(b"\n".join(left).decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            cols = [pa.array(texts, pa.string()) if k == text_at else b.column(k) for k in schema_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)

    return run


def drop_shared_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS, max_suspects: int = MAX_SUSPECTS, max_keys: int = MAX_KEYS
) -> DataFrame:
    """The rows of df with shared lines gone from text_col, and two more columns: n_lines (before) and n_dropped.

    A line's key is the line stripped of white space with A-Z lower-cased. Keys of min_chars code points that
    min_docs distinct ids hold lose all their lines, save in the largest id. All else stays, in order, joined by a line feed.

    Null or empty text: one empty line, which stays; the text returned is empty. A null id counts as no document and
    keeps no shared line. Rows that repeat an id count as one document and are treated alike. An empty table gives an
    empty one. Other columns pass unchanged; if they are called n_lines or n_dropped, the new ones get underscores in front.
    """
    spark, cols = df.sparkSession, df.columns
    id_at, text_at = cols.index(id_col), cols.index(text_col)
    slim = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    suspects = suspected_lines(slim, min_chars, max_filter_bits, max_suspects)
    shared = cut(suspects.groupBy("digest", "key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs).select("digest", "keep"))
    out = T.StructType([*df.schema.fields, *(T.StructField(fresh(cols, n), T.LongType()) for n in ("n_lines", "n_dropped"))])
    out.fields[text_at] = T.StructField(text_col, T.StringType())
    args = (min_chars,), (list(range(len(cols))), [f.name for f in out.fields], None)
    if shared.count() <= max_keys:
        known = shared.toArrow()
        keys = spark.sparkContext.broadcast(dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True)))
        return df.mapInArrow(_apply(id_at, text_at, *args[0], keys, None, *args[1]), out)
    lost = suspects.select("digest", "id").join(shared, "digest").filter(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id").agg(F.collect_set("digest").alias("lost"))
    at, ids = fresh(cols, "lost"), fresh(cols, "lost_id")
    lost = lost.select(F.col("id").alias(ids), F.col("lost").alias(at))
    joined = df.join(lost, quoted(id_col).eqNullSafe(quoted(ids)), "left").select(*(df[f"`{c}`"] for c in cols), quoted(at))
    return joined.mapInArrow(_apply(id_at, text_at, *args[0], None, len(cols), *args[1]), out)
