"""Exact distinct counts for all grouping sets, from one shuffle of the values instead of one per set.

A cell is a combination of keys. Each value gets a bit mask of the cells that it occurs in; values with equal masks are counted together,
and a group counts the masks that meet its own. With more cells than the masks hold, distinct pairs of cell and value are copied per set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import all_of, any_of
from .lineage import cut
from .weighted import expand

#: Cells in a mask's word, words at most.
BITS, WORDS = 62, 4


def distinct_counts(rows: DataFrame, keys: list[str], sets: dict[tuple[bool, ...], int], wanted: dict[str, Column]) -> list[DataFrame]:
    """For each of wanted (output name, expression on rows) a table of _g (number of the grouping set), keys and the number of distinct
    values that aren't null. Groups without any are absent."""
    at = ["_g", *keys]
    if len(sets) == 1:
        return [_of_pairs(expand(rows.select(*keys, c.alias("_who")).filter("_who is not null"), keys, sets).distinct(), at, n) for n, c in wanted.items()]
    cells = cut(rows.select(*keys).distinct())
    if (many := cells.count()) > BITS * WORDS:
        return [_of_pairs(expand(rows.select(*keys, c.alias("_who")).filter("_who is not null").distinct(), keys, sets).distinct(), at, n) for n, c in wanted.items()]
    words = [f"_m{i}" for i in range(max(1, -(-many // BITS)))]
    numbered = cells.withColumn("_n", F.row_number().over(Window.orderBy(*keys)) - 1)  # no more than the masks hold
    marks = cut(numbered.select(*keys, *(F.expr(f"if(_n div {BITS} = {i}, shiftleft(1L, _n % {BITS}), 0L)").alias(m) for i, m in enumerate(words))))
    groups = expand(marks, keys, sets).groupBy(*at).agg(*(F.bit_or(m).alias(f"{m}_own") for m in words))
    own = marks.select(*(F.col(k).alias(f"{k}_r") for k in keys), *words)
    meets = any_of(F.col(m).bitwiseAND(F.col(f"{m}_own")) != 0 for m in words)
    out = []
    for name, c in wanted.items():
        values = rows.select(*keys, c.alias("_who")).filter("_who is not null")
        masks = values.join(F.broadcast(own), all_of(F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys)).groupBy("_who").agg(*(F.bit_or(m).alias(m) for m in words))
        alike = masks.groupBy(*words).agg(F.count("*").alias("_n"))
        out.append(alike.join(F.broadcast(groups), meets).groupBy(*at).agg(F.sum("_n").alias(name)))
    return out


def _of_pairs(pairs: DataFrame, at: list[str], name: str) -> DataFrame:
    return pairs.groupBy(*at).agg(F.count("*").alias(name))
