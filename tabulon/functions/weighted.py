"""Weighted quantiles, deviation, quantile classes and weighted columns.

The weighted quantile is a step function from below: of rows sorted by value and weight, the last value at which the running
weight is at most q times the total, or the smallest value if there is none. Rows with a null value or weight don't count.
Ties are aggregated first (a value qualifies if its own lightest row does). A histogram finds the narrow bucket of each answer and
only rows in there are sorted, so that a group with very many values is neither copied nor a task of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import all_of, col, nan_to_null
from .lineage import cut

BUCKETS = 64
#: Steps of a histogram per power of two; rows of a bucket that are sorted in one task; histograms at most; rows of bounds sent to all tasks.
STEPS, SORTED_ROWS, ROUNDS, BROADCAST_ROWS = 1024, 1_000_000, 8, 200_000


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which nulls are equal."""
    right = right.select(*(F.col(k).alias(f"{k}_r") if k in keys else F.col(k) for k in right.columns))
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return left.join(right, out, "inner").drop(*(f"{k}_r" for k in keys))


def running_sum_before(rows: DataFrame, keys: list[str], order: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """rows (one for each value of order within the keys) with _before, the sum of value over smaller ones, and _total.

    Approximate quantiles cut each group to buckets; sums of buckets are few, and inside a bucket a window adds up. So
    no window holds a large group as a whole, and the result is exact wherever the cuts fall.
    """
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 1000).alias("_cuts"))
    placed = _meet(rows, cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    sums = placed.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_start"), F.sum("_s").over(whole).alias("_total"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = _meet(placed, sums, [*keys, "_b"])
    return out.withColumn("_before", F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))).drop("_b", "_start")


def expand(rows: DataFrame, keys: list[str], sets: dict[tuple[bool, ...], int]) -> DataFrame:
    """A copy of each row per grouping set (a flag per key, True where it stays): its number as _g, and null for keys that don't stay."""
    kinds = {k: rows.schema[k].dataType for k in keys}
    copies = F.array(*(F.struct(F.lit(g).alias("_g"), *((F.col(k) if stays else F.lit(None).cast(kinds[k])).alias(k) for k, stays in zip(keys, s, strict=True))) for s, g in sets.items()))
    others = [col(c) for c in rows.columns if c not in keys]
    return rows.select(F.explode(copies).alias("_s"), *others).select("_s.*", *others)


def _code(x: Column) -> Column:
    """A whole number that never falls as x grows: the power of two under its size, and STEPS equal steps from there to the next."""
    size = F.least(F.abs(x), F.lit(sys.float_info.max))
    power = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(size))))
    code = (power + 1100) * STEPS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS)
    return F.when(x > 0, code).when(x < 0, -code).otherwise(F.lit(0).cast("long"))


def _bucket() -> list[Column]:
    return [F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.min("_low").alias("_low"), F.max("_high").alias("_high")]


def _histogram(rows: DataFrame, at: list[str], x: Column) -> DataFrame:
    """Per code of x: sum of weights, number of rows, the least weight, the smallest and the largest value."""
    ones = rows.select(*at, x.alias("_code"), F.col("_v").alias("_low"), F.col("_v").alias("_high"), "_w", "_least", F.lit(1).alias("_n"))
    return ones.groupBy(*at, "_code").agg(*_bucket())


def _with_starts(buckets: DataFrame, at: list[str]) -> DataFrame:
    """buckets with _start (weight of those before), _prev (largest value before), and of the whole: _first (smallest value), _total."""
    whole = Window.partitionBy(*at) if at else Window.partitionBy(F.lit(0))
    order = whole.orderBy("_code")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select("*", F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_start"), F.lag("_high").over(order).alias("_prev"), F.min("_low").over(whole).alias("_first"), F.sum("_w").over(whole).alias("_total"))


def _last_bucket(buckets: DataFrame, at: list[str]) -> DataFrame:
    """Per target, the last bucket that begins at or under it."""
    take = ["_code", "_start", "_low", "_high", "_least", "_n", "_prev"]
    top = buckets.groupBy(*at).agg(F.max(F.when(F.col("_start") <= F.col("_at"), F.struct(*take))).alias("_b"), *(F.first(c).alias(c) for c in ("_at", "_first", "_total")))
    return top.select(*at, "_at", "_first", "_total", *(F.col(f"_b.{c}").alias(c) for c in take if c != "_code"))


def _last_under(rows: DataFrame, keys: list[str], sets: dict[tuple[bool, ...], int], targets: list[Callable[[Column], Column]], fallback) -> DataFrame:
    """_g, keys, _i (number of the target), _total, _found: for each group of the grouping sets the last _v at which the weight of smaller values plus
    the least weight of its own rows (_least) is at most the target, a function of the group's total; else the smallest. None if a weight is negative.

    A histogram by codes of the value gives the bucket of each answer; only rows inside these buckets are sorted. Buckets that still hold many
    rows of several values are cut again by their values' distance from the smallest. No row is copied or shuffled before its bucket is known.
    """
    at = ["_g", *keys]
    cells = cut(_histogram(rows, keys, _code(F.col("_v"))))
    if (cells.agg(F.min("_least")).first()[0] or 0) < 0:
        return fallback()
    buckets = _with_starts(expand(cells, keys, sets).groupBy(*at, "_code").agg(*_bucket()), at)
    goals = F.array(*(F.struct(F.lit(i).alias("_i"), t(F.col("_total")).cast("double").alias("_at")) for i, t in enumerate(targets)))
    mine = [*at, "_i"]
    picked = cut(_last_bucket(buckets.select("*", F.inline(goals)), mine))
    own = expand(cells.select(*keys).distinct().select(*keys, *(F.col(k).alias(f"{k}_own") for k in keys)), keys, sets) if keys else None
    for again in range(ROUNDS):
        # a bucket of one value is an answer
        wide = picked.filter("_low < _high")
        most = wide.agg(F.max("_n")).first()[0]
        if not most:
            break
        # which buckets a row can be in depends on its own keys
        near = wide.select(*mine, F.col("_low").alias("_from"), F.col("_high").alias("_to"))
        near = near if own is None else _meet(near, own, at).select(*(F.col(f"{k}_own").alias(f"{k}_own_r") for k in keys), *mine, "_from", "_to")
        few = near.count() <= BROADCAST_ROWS
        here = all_of([*(F.col(f"{k}_own").eqNullSafe(F.col(f"{k}_own_r")) for k in keys), F.col("_v").between(F.col("_from"), F.col("_to"))])
        inside = rows.select(*(F.col(k).alias(f"{k}_own") for k in keys), "_v", "_w", "_least").join(F.broadcast(near) if few else near, here).select(*mine, "_from", "_v", "_w", "_least")
        if most <= SORTED_ROWS or again == ROUNDS - 1:
            one = inside.groupBy(*mine, "_v").agg(F.sum("_w").alias("_w"), F.min("_least").alias("_least"))
            before = Window.partitionBy(*mine).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
            one = _meet(one.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0))), wide.select(*mine, "_start", "_at"), mine)
            found = one.groupBy(*mine).agg(F.max(F.when(F.col("_start") + F.col("_before") + F.col("_least") <= F.col("_at"), F.col("_v"))).alias("_inside"))
            found = found.select(*(F.col(k).alias(f"{k}_r") for k in mine), "_inside")
            picked = picked.join(found, all_of(F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in mine), "left").drop(*(f"{k}_r" for k in mine))
            break
        parts = _with_starts(_histogram(inside, mine, _code(F.col("_v") - F.col("_from"))), mine).drop("_first", "_total")
        outer = wide.select(*mine, "_at", "_first", "_total", F.col("_start").alias("_start0"), F.col("_prev").alias("_prev0"))
        parts = _meet(parts, outer, mine).withColumns({"_start": F.col("_start") + F.col("_start0"), "_prev": F.coalesce("_prev", "_prev0")})
        picked = cut(picked.filter("not coalesce(_low < _high, false)").unionByName(_last_bucket(parts, mine)))
    if "_inside" not in picked.columns:
        picked = picked.withColumn("_inside", F.lit(None).cast("double"))
    alone = F.when((F.col("_low") == F.col("_high")) & (F.col("_start") + F.col("_least") <= F.col("_at")), F.col("_low"))
    return picked.select(*mine, "_total", F.coalesce("_inside", alone, "_prev", "_first").alias("_found"))


def grouped_weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, qs: list[float], buckets: int = BUCKETS, sets: dict[tuple[bool, ...], int] | None = None) -> DataFrame:
    """keys, q_0, q_1, ... for each group of plain key columns (nulls are a group). With grouping sets: _g, the set's number, and the keys,
    null where they don't stay. Negative weights, under which running sums can fall, are added up over all values."""
    at, every = ([*keys], {(True,) * len(keys): 0}) if sets is None else (["_g", *keys], sets)
    rows = rows.filter(col(value).isNotNull() & col(weight).isNotNull()).select(*keys, col(value).cast("double").alias("_v"), col(weight).cast("double").alias("_w"), col(weight).cast("double").alias("_least"))

    def by_all_values():
        one = expand(rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"), F.min("_least").alias("_least")), keys, every)
        own = ["_g", *keys]
        one = one.groupBy(*own, "_v").agg(F.sum("_w").alias("_w"), F.min("_least").alias("_least"))
        both = running_sum_before(one, own, "_v", "_w", buckets).withColumn("_run", F.col("_before") + F.col("_least"))
        last = both.groupBy(*own).agg(F.max("_total").alias("_total"), *(F.coalesce(F.max(F.when(F.col("_run") <= q * F.col("_total"), F.col("_v"))), F.min("_v")).alias(f"_q{i}") for i, q in enumerate(qs)))
        return last.select(*own, "_total", F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(f"_q{i}").alias("_found")) for i in range(len(qs))))))

    found = _last_under(rows, keys, every, [lambda total, q=q: total * float(q) for q in qs], by_all_values)
    return found.groupBy(*at).agg(*(F.max(F.when(F.col("_i") == i, F.col("_found"))).alias(f"q_{i}") for i in range(len(qs))))


def grouped_quantiles(rows: DataFrame, keys: list[str], value: str, qs: list[float], buckets: int = BUCKETS, sets: dict[tuple[bool, ...], int] | None = None) -> DataFrame:
    """keys, q_0, q_1, ... as in grouped_weighted_quantiles, unweighted: linear interpolation between the two nearest ranks."""
    at, every = ([*keys], {(True,) * len(keys): 0}) if sets is None else (["_g", *keys], sets)
    rows = rows.filter(col(value).isNotNull()).select(*keys, col(value).cast("double").alias("_v"), F.lit(1.0).alias("_w"), F.lit(0.0).alias("_least"))
    targets = [lambda total, q=q, side=side: side(F.lit(float(q)) * (total - 1)) for q in qs for side in (F.floor, F.ceil)]
    found = _last_under(rows, keys, every, targets, None)
    both = found.groupBy(*at).agg(F.max("_total").alias("_total"), *(F.max(F.when(F.col("_i") == i, F.col("_found"))).alias(f"_r{i}") for i in range(len(targets))))

    def between(i: int, q: float):
        p, low, high = F.lit(float(q)) * (F.col("_total") - 1), F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return both.select(*at, *(between(i, q).alias(f"q_{i}") for i, q in enumerate(qs)))


def weighted_quantile(df: DataFrame, variables: list[str], weights: str | None = None, q: float | list[float] = 0.5) -> DataFrame:
    """One row per variable: variable, and a column per quantile (quantile, or q0.25, q0.5, ...). Without weights: linear interpolation."""
    qs = list(q) if isinstance(q, (list, tuple)) else [q]
    names = [f"q{x}" for x in qs] if isinstance(q, (list, tuple)) else ["quantile"]
    df = nan_to_null(df)
    pairs = F.array(*(F.struct(F.lit(v).alias("variable"), col(v).cast("double").alias("value")) for v in variables))
    long = df.select(F.explode(pairs).alias("p"), (col(weights).cast("double") if weights else F.lit(1.0)).alias("weight")).select("p.variable", "p.value", "weight")
    if weights is None:
        out = grouped_quantiles(long, ["variable"], "value", qs)
        return out.select("variable", *(F.col(f"q_{k}").alias(n) for k, n in enumerate(names)))
    out = grouped_weighted_quantiles(long, ["variable"], "value", "weight", qs)
    return out.select("variable", *(F.col(f"q_{k}").alias(n) for k, n in enumerate(names)))


def weighted_std(df: DataFrame, values: list[str], weights: str | None = None, axis: int | None = 0) -> DataFrame:
    """Population standard deviation under weights, in two passes. axis 0: one column per value; None: all values as one ("std");
    1: for each row over the values, where weights names an array column (or nothing), as a further column "std". A null or NaN raises an error."""

    def checked(v):
        c = col(v).cast("double")
        return F.when(c.isNull() | F.isnan(c), F.raise_error(F.lit(f"{v} has a missing value")).cast("double")).otherwise(c)

    if axis == 1:
        x = F.array(*map(checked, values))
        w = col(weights) if weights else F.array_repeat(F.lit(1.0), len(values))
        total = F.aggregate(w, F.lit(0.0), lambda a, y: a + y)
        mean = F.try_divide(F.aggregate(F.zip_with(x, w, lambda p, r: p * r), F.lit(0.0), lambda a, y: a + y), total)
        spread = F.aggregate(F.zip_with(F.transform(x, lambda p: (p - mean) * (p - mean)), w, lambda p, r: p * r), F.lit(0.0), lambda a, y: a + y)
        return df.withColumn("std", F.sqrt(F.try_divide(spread, total)))
    w = col(weights).cast("double") if weights else F.lit(1.0)
    rows = df.select(*(checked(v).alias(f"_{k}") for k, v in enumerate(values)), w.alias("_w"))
    names = values
    if axis is None:
        rows = rows.select(F.explode(F.array(*(f"_{k}" for k in range(len(values))))).alias("_0"), "_w")
        names = ["std"]
    means = rows.agg(*(F.try_divide(F.sum(F.col(f"_{k}") * F.col("_w")), F.sum("_w")).alias(f"_m{k}") for k in range(len(names))))
    both = rows.crossJoin(F.broadcast(means))  # one row
    return both.agg(*(F.sqrt(F.try_divide(F.sum(F.col("_w") * (F.col(f"_{k}") - F.col(f"_m{k}")) ** 2), F.sum("_w"))).alias(n) for k, n in enumerate(names)))


def assign_quantile(df: DataFrame, variable: str, quantiles: list[float], is_threshold: bool = False, output: str | None = None) -> DataFrame:
    """df with a class of variable by thresholds: how many are at most the value, or (is_threshold) the greatest of them, or else the smallest value of all rows."""
    output = output or f"{variable}_quantile"
    cuts, x = sorted(quantiles), col(variable).cast("double")
    if not is_threshold:
        label = sum(((x >= c).cast("int") for c in cuts), F.lit(0))
        return df.withColumn(output, F.when(x.isNotNull(), label))
    low = nan_to_null(df).agg(F.min(x).alias("_low"))
    out = F.col("_low")
    for c in cuts:
        out = F.when(x >= c, F.lit(float(c))).otherwise(out)
    return df.crossJoin(F.broadcast(low)).withColumn(output, F.when(x.isNotNull(), out)).drop("_low")


def create_pond_data(df: DataFrame, variables: list[str], keys: list[str] | None, weights: str) -> DataFrame:
    """The key columns, and each variable times the weight."""
    return df.select(*map(col, keys or []), *((col(v).cast("double") * col(weights).cast("double")).alias(v) for v in variables if v not in (keys or [])))
