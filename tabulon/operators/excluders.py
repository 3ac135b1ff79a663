"""Excluders of rows, columns and values: fit(df), transform(df), fit_transform(df)."""

from __future__ import annotations

import math
import random
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of, col, drop_missing, nan_to_null, require
from ..functions.weighted import weighted_quantile


class Excluder(Protocol):
    def fit(self, df: DataFrame): ...

    def transform(self, df: DataFrame) -> DataFrame: ...


class _Fitted:
    def fit(self, df: DataFrame):
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class ColumnExcluder(_Fitted):
    """Drops the named columns; one that isn't there raises KeyError."""

    def __init__(self, list_col_drop: list[str]):
        self.list_col_drop = list(list_col_drop)

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.list_col_drop)
        return df.drop(*map(col, self.list_col_drop))


OPERATORS = {">": lambda c, t: c > t, ">=": lambda c, t: c >= t, "<": lambda c, t: c < t, "<=": lambda c, t: c <= t, "==": lambda c, t: c == t, "!=": lambda c, t: ~c.eqNullSafe(F.lit(t))}


class ThresholdExcluder(_Fitted):
    """Criteria {variable, operator, threshold}. drop: rows stay that satisfy all. Otherwise each variable becomes null
    where a criterion of its own holds. A null satisfies != alone."""

    def __init__(self, list_criteria: list[dict], drop: bool = True):
        for c in list_criteria:
            if c["operator"] not in OPERATORS:
                raise ValueError(f"operator must be one of {list(OPERATORS)}")
        self.list_criteria, self.drop = list(list_criteria), drop

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [c["variable"] for c in self.list_criteria])
        df = nan_to_null(df)
        hit = [(c["variable"], OPERATORS[c["operator"]](col(c["variable"]), c["threshold"])) for c in self.list_criteria]
        if self.drop:
            return df.filter(all_of(F.coalesce(h, F.lit(False)) for _, h in hit))
        by: dict = {}
        for v, h in hit:
            by.setdefault(v, []).append(F.coalesce(h, F.lit(False)))
        return df.select(*(F.when(~any_of(by[c]), col(c)).alias(c) if c in by else col(c) for c in df.columns))


class QuantileExcluder(_Fitted):
    """Criteria {variable, side (left, right, both), threshold}, with exact quantiles over all rows of what is transformed. drop: rows stay that lie
    strictly inside; otherwise values strictly outside become null, and those on the bound stay."""

    def __init__(self, list_criteria: list[dict], drop: bool = True):
        for c in list_criteria:
            if c["side"] not in ("left", "right", "both"):
                raise ValueError("side must be left, right or both")
        self.list_criteria, self.drop = list(list_criteria), drop

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, [c["variable"] for c in self.list_criteria])
        df = nan_to_null(df)
        wanted, low, high = [], [], []
        for i, c in enumerate(self.list_criteria):
            v, t = c["variable"], c["threshold"]
            if c["side"] in ("left", "both"):
                wanted.append((v, t, f"_l{i}"))
                low.append((v, f"_l{i}"))
            if c["side"] in ("right", "both"):
                wanted.append((v, 1 - t, f"_r{i}"))
                high.append((v, f"_r{i}"))
        if not wanted:
            return df
        names, qs = sorted({v for v, _, _ in wanted}), sorted({q for _, q, _ in wanted})
        found = weighted_quantile(df, names, q=qs)
        cuts = found.agg(*(F.max(F.when(F.col("variable") == v, F.col(f"`q{q}`"))).alias(name) for v, q, name in wanted))
        both = df.crossJoin(F.broadcast(cuts))  # one row
        if self.drop:
            inside = [*(col(v) > F.col(q) for v, q in low), *(col(v) < F.col(q) for v, q in high)]
            return both.filter(all_of(inside)).select(*map(col, df.columns))
        out: dict = {}
        for v, hit in [*((v, col(v) < F.col(q)) for v, q in low), *((v, col(v) > F.col(q)) for v, q in high)]:
            out.setdefault(v, []).append(F.coalesce(hit, F.lit(False)))
        return both.select(*(F.when(~any_of(out[c]), col(c)).alias(c) if c in out else col(c) for c in df.columns))


class ForestOutliersIsolation(_Fitted):
    """Drops rows that an isolation forest takes for outliers (score over 0.5).

    Each tree is grown on the driver from its own few rows (max_samples at most) of a seeded sample of
    n_estimators * max_samples rows on average, in which each row has the same chance, equal rows too; all trees together are a few hundred small arrays, which every task gets. Scoring is one pass over batches. Rows with nulls have no score and stay.
    """

    def __init__(self, n_estimators: int = 100, random_state: int = 42, max_samples: int = 256, columns: list[str] | None = None):
        self.n_estimators, self.random_state, self.max_samples, self.columns = n_estimators, random_state, max_samples, columns
        self.trees: list | None = None

    @staticmethod
    def _path(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    def fit(self, df: DataFrame):
        self.used = self.columns or df.columns
        rows = drop_missing(nan_to_null(df.select(*map(col, self.used))))
        want = self.n_estimators * self.max_samples
        n = rows.count()
        picked = rows.sample(want / n, self.random_state) if n > want else rows
        found = [tuple(map(float, r)) for r in picked.collect()]
        data = np.array(sorted(found))
        rng = np.random.default_rng(self.random_state)
        pyrng = random.Random(self.random_state)
        self.size = min(self.max_samples, len(data))
        top = math.ceil(math.log2(max(2, self.size)))
        self.trees = [self._grow(data[rng.choice(len(data), self.size, replace=False)], top, pyrng) for _ in range(self.n_estimators)] if len(data) else []
        return self

    def _grow(self, rows, top, rng):
        """Nodes as (feature or -1, cut or path length, left, right)."""
        nodes: list = []

        def grow(x, depth):
            at = len(nodes)
            nodes.append(None)
            spread = [k for k in range(x.shape[1]) if x[:, k].min() < x[:, k].max()] if len(x) > 1 else []
            if depth >= top or not spread:
                nodes[at] = (-1, depth + self._path(len(x)), 0, 0)
                return at
            k = rng.choice(spread)
            cut = rng.uniform(x[:, k].min(), x[:, k].max())
            left = x[:, k] < cut
            nodes[at] = (k, cut, grow(x[left], depth + 1), grow(x[~left], depth + 1))
            return at

        grow(rows, 0)
        return np.array(nodes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees or []:
            at = np.zeros(len(x), int)
            while True:
                k = t[at, 0].astype(int)
                inner = k >= 0
                if not inner.any():
                    break
                go = np.flatnonzero(inner)
                left = x[go, k[go]] < t[at[go], 1]
                at[go] = np.where(left, t[at[go], 2], t[at[go], 3]).astype(int)
            total += t[at, 1]
        c = self._path(self.size) if self.trees else 1.0
        return 2.0 ** (-total / max(1, len(self.trees or [1])) / (c or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.trees is None:
            raise ValueError("fit first")
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def inlier(x: pd.DataFrame) -> pd.Series:
            v = x.to_numpy(dtype=float)
            some = ~np.isnan(v).any(axis=1)
            out = np.ones(len(v), bool)
            if some.any() and model.value.trees:
                out[some] = model.value.scores(v[some]) <= 0.5
            return pd.Series(out)

        return df.filter(inlier(F.struct(*(col(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.used)))))
