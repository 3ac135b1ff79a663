"""Benchmark decontamination: an FM-index of word ids for each shard of documents, searched for the benchmark's windows.

The benchmark's windows are a query set: they go to all tasks in blocks of a bounded number of words, and each block
is one pass over the documents. A task indexes its rows a shard at a time, so its memory is bounded, and no document
is shuffled: with several blocks, rows are numbered, and what a block finds meets its row by that number. Words that no item has are separators of the index, and runs of words shorter than the
shortest window can't hold one, so neither takes room in the index.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, cut, fresh, quoted, small_batches
from .fm_index import FmIndex

WINDOW = 10
SHARD_WORDS = 1 << 21
BLOCK_WORDS = 1 << 19  # about 200 MB on the driver while a block is made, 100 MB in a task
#: All but word bytes to a blank, A-Z to lower case; bytes from 0x80 are parts of word characters.
WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Windows:
    """The windows of a block of items: word ids by length, and which items have each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                by_length.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(k)
        self.items = [x[0] for x in items]
        self.groups = []
        for size, found in sorted(by_length.items()):
            owners = [sorted(v) for v in found.values()]
            self.groups.append((size, np.array(list(found), np.int64), np.array([x for v in owners for x in v]), np.r_[0, np.cumsum([len(v) for v in owners])]))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def scan(self, rows: list[list[bytes]]) -> list[tuple]:
        """For each row of words: (hit words as a list of [start, end) spans, items)."""
        out = [([], []) for _ in rows]
        lengths = np.array([len(r) for r in rows], np.int64)
        if not self.groups or not lengths.sum():
            return out
        get = self.vocabulary.get
        # a zero after each row
        ids = np.zeros(lengths.sum() + len(rows), np.int64)
        at = 0
        for r in rows:
            ids[at : at + len(r)] = np.fromiter((get(w, 0) for w in r), np.int64, len(r))
            at += len(r) + 1
        first = np.r_[0, np.cumsum(lengths + 1)]
        known = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0].astype(np.int8)))
        begin, end = known[::2], known[1::2]
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        size = end - begin + 1  # with the zero after the run
        place = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        index = FmIndex(ids[place], len(self.vocabulary))
        edge = np.zeros(len(ids) + 1, np.int64)
        pairs = []
        for width, patterns, owners, cuts in self.groups:
            which, where = index.occurrences(patterns)
            where = place[where]
            np.add.at(edge, where, 1)
            np.add.at(edge, where + width, -1)
            row = np.searchsorted(first, where, side="right") - 1
            both = np.unique(row * len(patterns) + which)
            row, which = both // len(patterns), both % len(patterns)
            n = cuts[which + 1] - cuts[which]
            own = np.repeat(cuts[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            pairs.append(np.repeat(row, n) * len(self.items) + (owners[own] if len(own) else own))
        for pair in np.unique(np.concatenate(pairs)).tolist():
            out[pair // len(self.items)][1].append(self.items[pair % len(self.items)])
        turns = np.flatnonzero(np.diff(np.r_[0, np.cumsum(edge)[:-1] > 0, 0].astype(np.int8)))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            row = int(np.searchsorted(first, a, side="right") - 1)
            out[row][0].append((a - int(first[row]), b - int(first[row])))
        return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of characters."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def removed(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of characters; what stood around each is joined by one blank, or a line feed if the span's edges have one."""
    out, at = [], 0
    for a, b in [*spans, (len(text), len(text))]:
        out.append(text[at:a].rstrip(" ") if out else text[at:a])
        at = b
    return " ".join(x.lstrip(" ") if k else x for k, x in enumerate(out)).strip(" ") if spans else text


def clean(text: str, windows: list[Windows], spans: list[tuple[int, int]]) -> str:
    """Without its spans, and without windows that come about where the rest is joined."""
    while spans:
        text = removed(text, char_spans(text, spans))
        spans = merged([s for w in windows for s in w.scan([words_of(text.encode())])[0][0]])
    return text


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _search(text_at: int, sent, pass_on: bool, with_clean: bool, names: list[str], item_type):
    def run(batches):
        windows: Windows = sent.value
        struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])

        def shard(held):
            words = [w for _, rows in held for w in rows]
            found = windows.scan(words)
            at = 0
            for b, rows in held:
                mine = found[at : at + len(rows)]
                at += len(rows)
                cols = [
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([sum(y - x for x, y in s) for s, _ in mine], pa.int64()),
                    pa.array([list(dict.fromkeys(items)) for _, items in mine], pa.list_(item_type)),
                    pa.array([[{"start": x, "end": y} for x, y in s] for s, _ in mine], pa.list_(struct)),
                ]
                if with_clean:
                    texts = b.column(text_at).to_pylist()
                    cols.append(pa.array([clean(t, [windows], s) if s else t for t, (s, _) in zip(texts, mine, strict=True)], pa.string()))
                own = b.columns if pass_on else [b.column(0)]
                yield pa.RecordBatch.from_arrays([*own, *cols], names)

        held, n = [], 0
        for b in small_batches(batches, 4.0):
            rows = [words_of(t) for t in binary(b, text_at)]
            held.append((b, rows))
            n += sum(map(len, rows))
            if n >= SHARD_WORDS:
                yield from shard(held)
                held, n = [], 0
        if held:
            yield from shard(held)

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS):
    """The items in blocks of at most about so many words (one item at least), read a partition at a time."""
    block, n = [], 0
    for item, text in benchmark.select(quoted(id_col), quoted(text_col).cast("string")).toLocalIterator():
        more = len(words_of((text or "").encode()))
        if block and n + more > block_words:
            yield block
            block, n = [], 0
        block.append((item, text))
        n += more
    yield block


def find_benchmark(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of df: the id, n_words, n_hit (words inside occurrences), items (found ones), spans (of words, merged).

    A window is window consecutive words of an item, or the whole of a shorter one; words are runs of ASCII letters and
    digits and all characters beyond ASCII, with A-Z lower-cased. Null or empty text has no words; an item without
    words is never found. A null item id is returned as a null in items; items that repeat an id count as one. Ids may be null or repeated in df,
    each row gets a row. An empty table gives an empty one; an empty benchmark gives no hits. Extra columns are ignored. Rows don't depend on block_words; the
    items of a row come in the order of the benchmark's blocks.
    """
    names, spark = [id_col], df.sparkSession
    for n in ("n_words", "n_hit", "items", "spans"):
        names.append(fresh(names, n))
    item_type = benchmark.schema[item_col].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (df.schema[id_col].dataType, T.LongType(), T.LongType(), T.ArrayType(item_type), span), strict=True)])
    from pyspark.sql.pandas.types import to_arrow_type

    slim = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))

    def search(rows: DataFrame, block: list, names: list[str], schema: T.StructType) -> DataFrame:
        sent = spark.sparkContext.broadcast(Windows(block, window))
        return rows.mapInArrow(_search(1, sent, False, False, names, to_arrow_type(item_type)), schema)

    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return search(slim, block, names, schema)
    # the numbers are written once, so they stay what they are
    rows = cut(slim.select(F.monotonically_increasing_id().alias("row"), "text", "id"))
    plain = ["row", "n_words", "n_hit", "items", "spans"]
    numbered = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, (T.StructField("row", T.LongType()), *schema.fields[1:]), strict=True)])
    first = search(rows, block, plain, numbered)
    found = first.filter("n_hit > 0").select("row", "items", "spans")
    while following is not None:
        found = found.unionByName(search(rows, following, plain, numbered).filter("n_hit > 0").select("row", "items", "spans"))
        following = next(blocks, None)
    found = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def join(acc, x):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(x))
        )

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    found = found.withColumn("spans", F.aggregate("spans", none, join)).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    whole = rows.select("row", "id").join(first.select("row", "n_words"), "row").join(found, "row", "left")
    filled = (F.col("id"), F.col("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast(T.ArrayType(item_type))), F.coalesce("spans", none))
    return whole.select(*(c.alias(n) for c, n in zip(filled, names, strict=True)))


def remove_benchmark(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df with every occurrence of a window cut out of text_col; rows without any are returned as they are.

    Null and empty texts, null and repeated ids and all other columns, whatever their names, pass unchanged; equal rows are treated alike. A text that is one
    window becomes empty. What is left is joined by a blank, and windows that come about there go too. An empty table, or an empty benchmark, changes nothing.
    The blocks of a large benchmark are applied one after the other, each over the written result of the one before, and again until the number of hits is zero.
    """
    spark, cols = df.sparkSession, df.columns
    names = list(cols)
    for n in ("n_words", "n_hit", "items", "spans", "clean"):
        names.append(fresh(names, n))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    types = (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), span, T.StringType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in zip(names[len(cols) :], types, strict=True))])
    # items are numbered here: their ids don't matter for the cut
    sents = [spark.sparkContext.broadcast(Windows([(k, t) for k, (_, t) in enumerate(b)], window)) for b in item_blocks(benchmark, item_col, item_text_col, block_words)]
    at = cols.index(text_col)

    def search(rows: DataFrame, sent) -> DataFrame:
        return rows.mapInArrow(_search(at, sent, True, True, names, pa.int64()), schema)

    while True:
        hits = 0
        for sent in sents:
            found = search(df, sent)
            if len(sents) > 1:
                found = cut(found)
                hits += found.agg(F.sum(quoted(names[len(cols) + 1]))).first()[0] or 0
            df = found.select(*(quoted(names[-1]).alias(c) if c == text_col else found[f"`{c}`"] for c in cols))
        if not hits:
            return df
