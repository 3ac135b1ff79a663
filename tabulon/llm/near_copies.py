"""Near copies by the Jaccard similarity of their word shingles: candidates by SimHash fingerprints and by MinHash bands, confirmed by the exact similarity.

A document is the set of its distinct shingles; equal sets are one. Fingerprints that lie within the radius of the index in Gray order make the
first candidates, which are nearly copies. Fingerprints of pairs at 0.8 differ in up to some 15 bits, a radius at which that index prunes nothing, so the others
are found by bands: two sets with similarity s agree in a band of ROWS minima with probability s**ROWS,
so at 0.8 all of BANDS bands miss a pair with probability 7e-6. Sets that meet in a band are candidates. Those in which less than LIKELY of the
BANDS * ROWS minima agree go (five standard deviations below 0.8, at which 3e-7 of the pairs lie lower). The shingles of the others are read again, and only pairs
whose exact similarity reaches the share are links. Within a band's group each set is held against one of it first; then
those that aren't linked with it (odd ones) are held against all the others, so no link of a group is left out.
That is done in tasks that get a block of odd ones and a block of others, first by minima, then by the sets of those that have a likely partner; a
task sends on a spanning forest, so no table holds a group's pairs.
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
from .simhash import RADIUS, components, link_fingerprints, majority_bits, shingle_hashes

WIDTH, SHARE = 5, 0.8
BANDS, ROWS = 30, 5
LIKELY = 5  # standard deviations
SALTS = 32
BROADCAST_ROWS = 300_000  # of three longs
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 21
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_U = np.uint64
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.int64).view(_U) * _U(2) + _U(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words (fewer words are one run), with A-Z lower-cased; none without words."""
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One number for each band, a hash of its number and minima; and a byte of each minimum."""
    low = np.full(BANDS * ROWS, ~_U(0))
    for at in range(0, len(hashes), 256):
        np.minimum(low, ((hashes[at : at + 256, None] ^ _FACTORS[1]) * _FACTORS[0]).min(axis=0), out=low)
    return np.array([_HASH(bytes([k]) + row.tobytes()) for k, row in enumerate(low.reshape(BANDS, ROWS))], _U), (low >> _U(20)).astype(np.uint8).tobytes()


def _key(hashes: np.ndarray) -> int:
    return _HASH(hashes.tobytes())


def _prints(width: int):
    def run(batches):
        for b in small_batches(batches):
            told = [shingle_hashes(t, width) for t in binary(b, 2)]
            prints = np.fromiter(map(majority_bits, told), _U, len(told)).view(np.int64)
            sets = list(map(np.unique, told))
            keys = np.fromiter(map(_key, sets), _U, len(sets)).view(np.int64)
            found = [bands(s) if len(s) else (np.zeros(0, _U), b"") for s in sets]
            cols = [b.column(0), b.column(1), pa.array(keys), pa.array(prints), pa.array([len(s) for s in sets], pa.int64())]
            cols += [pa.array([x.view(np.int64) for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "t", "key", "fp", "n", "bands", "minima"])

    return run


def _sets(width: int):
    def run(batches):
        for b in small_batches(batches):
            sets = [shingles(t, width) for t in binary(b, 0)]
            keys = np.fromiter(map(_key, sets), _U, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "held"])

    return run


def _agree(share: float):
    """The pairs whose minima agree in so many places that their similarity may be the share; columns a, b, and the minima of both."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= _least(share)))

    return run


def _least(share: float) -> float:
    """Minima that agree, of two sets with this similarity, but for LIKELY standard deviations."""
    return (share - LIKELY * (share * (1 - share) / (BANDS * ROWS)) ** 0.5) * BANDS * ROWS


def _fits(n: np.ndarray, m, share: float) -> np.ndarray:
    return np.minimum(n, m) >= share * np.maximum(n, m) - 1e-9


def _active(share: float):
    """Of a block (odd ones and others with their minima), those with a likely partner in another component."""

    def run(t: pa.Table) -> pa.Table:
        odd = t.column("odd").to_numpy()
        n, root = t.column("n").to_numpy(), t.column("root").to_numpy()
        minima = np.frombuffer(b"".join(t.column("minima").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        mine, others = np.flatnonzero(odd), np.flatnonzero(~odd)
        keep, least = np.zeros(t.num_rows, bool), _least(share)
        for k in mine:
            near = others[_fits(n[others], n[k], share) & (root[others] != root[k])]
            near = near[(minima[near] == minima[k]).sum(axis=1) >= least]
            keep[k] |= len(near) > 0
            keep[near] = True
        return t.select(["band", "i", "j", "key", "n", "root", "odd"]).filter(pa.array(keep))

    return run


def _forest(share: float):
    """Links (a, b) of a block by the exact similarity of its sets, as many as join its components."""

    def run(t: pa.Table) -> pa.Table:
        odd, key, n = t.column("odd").to_numpy(), t.column("key").to_numpy(), t.column("n").to_numpy()
        names, root = np.unique(t.column("root").to_numpy(), return_inverse=True)
        held = t.column("held").combine_chunks()
        flat, cuts = held.flatten().to_numpy().view(_U), np.r_[0, np.cumsum(held.value_lengths().to_numpy())]
        others, owner = np.flatnonzero(~odd), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        there = ~odd[owner]
        order = np.argsort(flat[there], kind="stable")
        hashes, owner = flat[there][order], owner[there][order]
        label, links = np.arange(len(names)), []
        for k in np.flatnonzero(odd):
            mine = flat[cuts[k] : cuts[k + 1]]
            lo, hi = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            size = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            both = np.bincount(owner[at], minlength=t.num_rows)[others]
            near = others[both >= share * (n[k] + n[others] - both) - 1e-9]
            # one partner of each further component
            _, firsts = np.unique(label[root[near]], return_index=True)
            for x in near[firsts]:
                a, b = label[root[k]], label[root[x]]
                if a != b:
                    links.append((key[k], key[x]))
                    label[label == b] = a
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def beside(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) with both values (key, name) as x and y; b may stand in very many pairs, which are dealt by salts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    far = salted.select("b", "salt").distinct().join(values.select(F.col("key").alias("b"), F.col(name).alias("y")), "b")
    near = salted.join(values.select(F.col("key").alias("a"), F.col(name).alias("x")), "a")
    return near.join(far, ["b", "salt"]).select("a", "b", "x", "y")


def similar(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have this similarity."""
    both = beside(pairs, sets, "held").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return both.filter(F.col("both") >= share * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b")


def _linked(df: DataFrame, id_col: str, text_col: str, width: int, share: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, key) of each row, and (key, first, root) of each set: its smallest id, and the smallest key of its component."""
    id_type = df.schema[id_col].dataType
    slim = df.select(quoted(id_col).alias("id"), F.xxhash64(quoted(text_col).cast("string")).alias("t"), quoted(text_col).cast("string").alias("text"))
    longs = (T.StructField(x, T.LongType()) for x in ("t", "key", "fp", "n"))
    schema = T.StructType([T.StructField("id", id_type), *longs, T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("minima", T.BinaryType())])
    prints = cut(slim.mapInArrow(_prints(width), schema))
    first = cut(prints.groupBy("key").agg(F.min("id").alias("first"), F.min("t").alias("t"), F.min("fp").alias("fp"), F.min("n").alias("n")))
    placed = prints.select("key", F.explode("bands").alias("band"))
    meets = packed(placed.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("band", "low"))
    few = meets.count() <= BROADCAST_ROWS
    members = packed(placed.join(F.broadcast(meets) if few else meets, "band").distinct().join(first.select("key", "n"), "key"))
    # candidates of the index in Gray order: sets of one fingerprint, and a spanning forest of the near fingerprints
    tops = packed(first.groupBy("fp").agg(F.min("key").alias("hub")))
    same = first.join(tops, "fp").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    forest = link_fingerprints(tops, radius).join(tops.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(tops.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b")
    close = same.unionByName(forest.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("a <> b")

    stars = members.select(F.col("key").alias("a"), F.col("low").alias("b")).filter("a <> b")
    pairs = packed(stars.unionByName(close).distinct())
    ends = packed(members.select("key").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("key"))).distinct())
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    minima = cut(prints.select("key", "minima").join(ends, "key", "left_semi").dropDuplicates(["key"]))

    def sets_of(keys: DataFrame) -> DataFrame:
        """(key, held) of these distinct keys, from one text of each."""
        wanted = first.join(keys, "key", "left_semi").select("t")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        texts = slim.join(wanted, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
        return cut(texts.select("text").mapInArrow(_sets(width), "key long, held array<long>"))

    def keys_of(pairs: DataFrame) -> DataFrame:
        return packed(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())

    likely = packed(beside(pairs, minima, "minima").mapInArrow(_agree(share), "a long, b long"))
    links = packed(similar(likely, sets_of(keys_of(likely)), share))
    # in a group of three and more, whoever isn't linked with its lowest key; the others are one component
    sure = members.join(links.select(F.col("a").alias("key"), F.col("b").alias("low"), F.lit(True).alias("sure")), ["key", "low"], "left")
    sure = sure.withColumn("odd", F.col("sure").isNull() & (F.col("key") != F.col("low"))).withColumn("root", F.when(F.col("odd"), F.col("key")).otherwise(F.col("low"))).drop("sure", "low")

    def blocks(which) -> DataFrame:
        parts = F.greatest(F.count_if(which) / BLOCK_SETS, F.sum(F.when(which, F.col("n"))) / BLOCK_SHINGLES)
        return F.greatest(F.ceil(parts), F.lit(1)).cast("int")

    sure = packed(sure)
    dealt = sure.groupBy("band").agg(F.count("*").alias("size"), blocks(F.col("odd")).alias("down"), blocks(F.lit(True)).alias("across"), F.bool_or("odd").alias("open")).filter("open and size > 2")
    dealt = sure.join(dealt.select("band", "down", "across"), "band").withColumn("at", F.xxhash64("key"))
    one = dealt.filter("odd").select("band", "key", "n", "root", "odd", F.pmod("at", "down").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    all_ = dealt.select("band", "key", "n", "root", F.lit(False).alias("odd"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod("at", "across").cast("int").alias("j"))
    shape = "band long, i int, j int, key long, n long, root long, odd boolean"
    block = ["band", "i", "j"]
    active = packed(one.unionByName(all_).join(minima, "key").groupBy(*block).applyInArrow(_active(share), shape))
    if not active.isEmpty():
        sets = sets_of(packed(active.select("key").distinct()))
        links = links.unionByName(active.join(sets, "key").groupBy(*block).applyInArrow(_forest(share), "a long, b long"))
    roots = components(links)
    rooted = first.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    return prints.select("id", "key"), rooted


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: float = SHARE, radius: int = RADIUS) -> DataFrame:
    """One row per row of df: the id, component_id (the smallest id reached over links of this similarity; null where no id is).

    Null, empty and blank texts are copies of each other. Ids may be null or repeated; each row gets a row. An empty table gives an empty one. Extra columns
    are ignored.
    """
    names = [id_col, fresh([id_col], "component_id")]
    rows, rooted = _linked(df, id_col, text_col, width, share, radius)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("low"))
    out = rows.join(rooted.join(lowest, "root").select("key", "low"), "key")
    return out.select(F.col("id").alias(names[0]), F.col("low").alias(names[1]))


def keep_one_copy(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: float = SHARE, radius: int = RADIUS) -> DataFrame:
    """The rows of df whose id is the smallest of a component, with all columns as they are.

    Null, empty and blank texts are copies of each other. Null ids stay; rows that repeat an id stay or go together. An empty table gives an empty one.
    """
    rows, rooted = _linked(df, id_col, text_col, width, share, radius)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("low")).filter("low is not null").select("low")
    name = fresh(df.columns, "gone")
    gone = packed(rows.filter("id is not null").join(lowest, F.col("id") == F.col("low"), "left_anti").select(F.col("id").alias(name)).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return df.join(gone, quoted(id_col) == quoted(name), "left_anti")
