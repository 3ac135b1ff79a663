"""Sums of products of columns, in one aggregation: all that linear models need from the data."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

MAX_EXPRESSIONS = 600  # beyond, partial sums are taken in batches instead of generated code


def partial_sums(df: DataFrame, columns: list[Column], f, by: list[str] | None = None) -> dict:
    """Sums over all rows of f(rows as a matrix) -> vector, taken per batch and added up; with by, for each group of those columns."""
    by, n = by or [], len(columns)
    slim = df.select(*(col(b) for b in by), *(c.cast("double").alias(f"_{i}") for i, c in enumerate(columns)))

    def run(batches):
        held: dict = {}
        for b in batches:
            for key, part in b.groupby(by, dropna=False) if by else [((), b)]:
                v = f(part[[f"_{i}" for i in range(n)]].to_numpy(float))
                held[key] = held.get(key, 0.0) + v
        for key, v in held.items():
            rows = pd.DataFrame({"_at": np.arange(len(v)), "_v": v})
            for name, k in zip(by, key if isinstance(key, tuple) else (key,), strict=True):
                rows[name] = k
            yield rows

    schema = ", ".join([*(f"`{b}` {slim.schema[b].dataType.simpleString()}" for b in by), "_at long", "_v double"])
    got = slim.mapInPandas(lambda it: (x[[*by, "_at", "_v"]] for x in run(it)), schema).groupBy(*map(col, by), "_at").agg(F.sum("_v").alias("_v")).collect()
    out: dict = {}
    for r in got:
        out.setdefault(tuple(r[b] for b in by), {})[r["_at"]] = r["_v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


@dataclass
class Moments:
    """n rows, total weight, means and the centred matrix of weighted products of the columns (the target is the last one)."""

    n: int
    weight: float
    mean: np.ndarray
    centred: np.ndarray

    @property
    def raw(self) -> np.ndarray:
        return self.centred + self.weight * np.outer(self.mean, self.mean)


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> Moments:
    """Two passes: means, then products around them, so that large means cost no digits."""
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    k = len(columns)
    rows = df.select(*(c.cast("double").alias(f"_{i}") for i, c in enumerate(columns)), w.alias("_w"))
    first = rows.agg(F.count("*"), F.sum("_w"), *(F.sum(F.col(f"_{i}") * F.col("_w")) for i in range(k))).first()
    n, total = first[0], first[1] or 0.0
    mean = np.array([(x or 0.0) / total if total else 0.0 for x in first[2:]])
    if k * (k + 1) // 2 <= MAX_EXPRESSIONS:
        d = [F.col(f"_{i}") - F.lit(float(mean[i])) for i in range(k)]
        sums = rows.agg(*(F.sum(F.col("_w") * d[i] * d[j]) for i in range(k) for j in range(i, k))).first()
        flat = [x or 0.0 for x in sums]
    else:

        def products(m):
            c = m[:, :-1] - mean
            return (c.T @ (c * m[:, -1:]))[np.triu_indices(k)]

        got = partial_sums(rows, [*(F.col(f"_{i}") for i in range(k)), F.col("_w")], products)
        flat = got.get((), np.zeros(k * (k + 1) // 2))
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    out = out + np.triu(out, 1).T
    return Moments(n, total, mean, out)


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(solution, inverse, rank) of a symmetric system, scaled to unit diagonal; a deficient one gets the pseudo-inverse."""
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    m = a / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(m)
    good = values > 1e-12 * max(1.0, values.max(initial=0.0)) * len(a)
    inv = (vectors[:, good] / values[good]) @ vectors[:, good].T / np.outer(scale, scale)
    if good.all():
        inv = np.linalg.inv(m) / np.outer(scale, scale)
    return inv @ b, inv, int(good.sum())
