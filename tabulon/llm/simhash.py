"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints sorted by Gray rank lie next to those that differ in few bits. Groups of neighbours share many bits;
a node of the index holds the bits that its children share (a mask and a pattern), and each child only the others, so a search adds
up differences on the way down and leaves a whole group once they exceed the radius.

The same structure deals the work out. Its upper part, the nodes of which are cut by rank so that each has about as many fingerprints
(from a bounded sample; the nodes cover all possible fingerprints), is searched for each distinct fingerprint, which goes to its own
node and to later ones within the radius. Each of those nodes indexes its own fingerprints and links them with those that came, exactly. A node sends on a spanning forest,
not its links, and the forests are joined to components in rounds over small tables.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, cut, fresh, packed, quoted, small_batches

SHINGLE, RADIUS = 3, 2
FAN = 16
SAMPLE_ROWS = 1_000_000  # to place the cuts between nodes; 8 MB
NODE_ROWS, LEAST_NODES = 100_000, 64
FRONTIER = 1 << 20
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_U = np.uint64


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of the runs of width words with A-Z lower-cased, repeats included (fewer words are one run); none without words."""
    words = text.lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return np.zeros(0, "<u8")
    shingles = zip(*(words[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
    return np.fromiter(map(_HASH, map(b" ".join, shingles)), "<u8", max(1, len(words) - width + 1))


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits: those set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The majority bits of the text's shingles; zero without words."""
    return majority_bits(shingle_hashes(text, width))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order in which neighbours differ by one bit."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> _U(s)
    return r


def cover(sample: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and masks of nodes in Gray order that cover all codes once, each with about as many of the sample."""
    ranks = np.sort(gray_rank(sample))
    cap = max(1, len(ranks) // max(1, nodes))
    found = []
    stack = [(0, 0, 0, len(ranks))]  # prefix, its bits, range of the sample
    while stack:
        prefix, bits, lo, hi = stack.pop()
        if hi - lo <= cap or bits == 64:
            mask = ((1 << bits) - 1) << (64 - bits)
            first = prefix << (64 - bits)
            found.append((first, (first ^ (first >> 1)) & mask, mask))
            continue
        mid = lo + int(np.searchsorted(ranks[lo:hi], _U((2 * prefix + 1) << (63 - bits))))
        stack += [(2 * prefix, bits + 1, lo, mid), (2 * prefix + 1, bits + 1, mid, hi)]
    found.sort()
    return np.array([x[1] for x in found], _U), np.array([x[2] for x in found], _U)


class GrayIndex:
    """Levels of (pattern, mask) over entries in Gray order; a mask lacks the bits that nodes above already compare."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, fan: int = FAN):
        masks = np.full(len(patterns), ~_U(0)) if masks is None else masks
        self.fan, self.levels = fan, []
        while True:
            if len(patterns) <= fan:
                self.levels.append((patterns, masks))
                break
            starts = np.arange(0, len(patterns), fan)
            differ = np.bitwise_or.reduceat(patterns ^ np.repeat(patterns[starts], fan)[: len(patterns)], starts)
            shared = np.bitwise_and.reduceat(masks, starts) & ~differ
            self.levels.append((patterns, masks & ~np.repeat(shared, fan)[: len(patterns)]))
            patterns, masks = patterns[starts] & shared, shared
        self.levels.reverse()

    def search(self, queries: np.ndarray, radius: int):
        """Blocks of (query, entry, difference) within the radius. The frontier is bounded: a block that needs more is halved."""
        todo = [(at, min(at + 4096, len(queries))) for at in range(0, len(queries), 4096)][::-1]
        while todo:
            lo, hi = todo.pop()
            q = np.repeat(np.arange(lo, hi), len(self.levels[0][0]))
            e = np.tile(np.arange(len(self.levels[0][0])), hi - lo)
            acc = np.zeros(len(q), np.uint8)
            for k, (patterns, masks) in enumerate(self.levels):
                if k:
                    q, e, acc = np.repeat(q, self.fan), (np.repeat(e * self.fan, self.fan).reshape(-1, self.fan) + np.arange(self.fan)).ravel(), np.repeat(acc, self.fan)
                    there = e < len(patterns)
                    if not there.all():
                        q, e, acc = q[there], e[there], acc[there]
                acc = acc + np.bitwise_count((queries[q] ^ patterns[e]) & masks[e])
                near = acc <= radius
                q, e, acc = q[near], e[near], acc[near]
                if len(q) > FRONTIER and hi - lo > 1:
                    mid = (lo + hi) // 2
                    todo += [(mid, hi), (lo, mid)]
                    break
            else:
                yield q, e, acc


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components under further links: label has each node's smallest known one, and stays fully followed."""
    while True:
        la, lb = label[a], label[b]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        new = lo != hi
        if not new.any():
            return label
        a, b = a[new], b[new]
        np.minimum.at(label, hi[new], lo[new])
        while (label != (further := label[label])).any():
            label = further


def _prints(width: int):
    def run(batches):
        for b in small_batches(batches):
            prints = np.fromiter((fingerprint(t, width) for t in binary(b, 1)), _U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return run


def _deal(sent, radius: int):
    def run(batches):
        index = GrayIndex(*sent.value)
        for b in batches:
            codes = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            for q, e, acc in index.search(codes, radius):
                own = np.zeros(len(codes), np.int64)
                own[q[acc == 0]] = e[acc == 0]  # one node has each code
                keep = e >= own[q]
                yield pa.RecordBatch.from_arrays([pa.array(e[keep]), pa.array(codes[q[keep]].view(np.int64)), pa.array((e == own[q])[keep])], ["node", "fp", "own"])

    return run


def _link(radius: int):
    def run(t: pa.Table) -> pa.Table:
        codes = t.column("fp").to_numpy().astype(np.int64).view(_U)
        own = t.column("own").to_numpy()
        order = np.argsort(gray_rank(codes[own]))
        members = np.flatnonzero(own)[order]
        label = np.arange(len(codes))
        if len(members):
            for q, e, _ in GrayIndex(codes[members]).search(codes, radius):
                e = members[e]
                other = q != e
                label = join_labels(label, q[other], e[other])
        linked = np.flatnonzero(label != np.arange(len(codes)))
        return pa.table({"a": pa.array(codes[linked].view(np.int64)), "b": pa.array(codes[label[linked]].view(np.int64))})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), by large and small stars in turn; root is the smallest node.

    Every round reads and writes small tables, cut off by a checkpoint. Minima are aggregated before they are joined,
    so a node with very many neighbours is no task of its own.
    """
    edges = packed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def state(e):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = packed(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        last, now = now, state(edges)
        if now == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS, least_nodes: int = LEAST_NODES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(a, b): a spanning forest of the links between fingerprints that differ in radius bits at most. The column fp is distinct, and the table materialised."""
    spark = prints.sparkSession
    distinct = prints.select("fp")
    n = distinct.count()
    part = n // sample_rows + 1
    sample = np.array([r[0] for r in distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).collect()], np.int64).view(_U)
    sent = spark.sparkContext.broadcast(cover(sample, max(least_nodes, n // node_rows)))
    dealt = distinct.mapInArrow(_deal(sent, radius), "node long, fp long, own boolean")
    return dealt.groupBy("node").applyInArrow(_link(radius), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS, **index) -> DataFrame:
    """One row per row of df: the id, fingerprint (16 hex digits), component_id (the smallest id reached over links).

    Shingles are width words (by [\\x20\\x09-\\x0D]) of the text with A-Z lower-cased, joined by a blank, repeats included;
    their hash is XXH64 with seed 42. Fewer words are one shingle. Null, empty or blank text: fingerprint zero, linked
    like any other. A null id gets a fingerprint, and counts for no component_id (null where no id is reached). Rows that repeat an id each
    get a row. An empty table gives an empty one. Extra columns are ignored.
    """
    names = [id_col]
    for n in ("fingerprint", "component_id"):
        names.append(fresh(names, n))
    id_type = df.schema[id_col].dataType
    slim = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    prints = cut(slim.mapInArrow(_prints(width), T.StructType([T.StructField("id", id_type), T.StructField("fp", T.LongType())])))
    first = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(link_fingerprints(first, radius, **index))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("low"))
    out = prints.join(rooted.join(lowest, "root").select("fp", "low"), "fp")
    return out.select(F.col("id").alias(names[0]), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias(names[1]), F.col("low").alias(names[2]))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df whose id is the smallest of its component (rows that repeat that id stay; null ids stay)."""
    found = near_duplicates(df, id_col, text_col, **how)
    ids = found.columns
    gone = found.filter(quoted(ids[0]) != quoted(ids[2])).select(quoted(ids[0]).alias(fresh(df.columns, "gone"))).distinct()
    return df.join(gone, quoted(id_col) == quoted(gone.columns[0]), "left_anti")
