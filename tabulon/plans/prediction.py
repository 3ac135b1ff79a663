"""Out-of-fold predictions, with bootstrap intervals for least squares from grouped sums."""

from __future__ import annotations

import copy
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, drop_missing, nan_to_null, require
from ..functions.moments import solve
from ..operators.regressors import LeastSquaresEstimator


def fold_of(id_col: str, k: int, seed: int = 0) -> Column:
    """A fold for each row from a hash of its id: the same for every order and partitioning of the rows."""
    return F.pmod(F.xxhash64(col(id_col), F.lit(seed)), F.lit(k)).cast("int")


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def poisson_weight(rate: float, *parts: Column) -> Column:
    """A Poisson number from a hash: how often a bootstrap draw takes the row. The numbers end where the next has a probability under 2 ** -40, the step of the hash."""
    if not 0 < rate <= 100:
        raise ValueError("a row's mean number of draws must be over 0 and at most 100")
    u, out, p, total, n = _uniform(*parts), F.lit(0), math.exp(-rate), 0.0, 0
    while n <= rate or p > 2.0**-41:
        total += p
        out = out + (u > total).cast("int")
        n += 1
        p *= rate / n
    return out


def _grouped_fits(rows: DataFrame, features: list[str], target: str, by: list[str], weight: Column) -> dict:
    """Sums of products by group, in one aggregation: {group: matrix over (features, target)}."""
    names = [*features, target]
    k = len(names)
    made = rows.select(*map(col, by), *(col(n).cast("double").alias(f"_{i}") for i, n in enumerate(names)), weight.alias("_w"))
    got = made.groupBy(*by).agg(*(F.sum(F.col("_w") * F.col(f"_{i}") * F.col(f"_{j}")) for i in range(k) for j in range(i, k))).collect()
    out = {}
    for r in got:
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = [x or 0.0 for x in r[len(by) :]]
        out[tuple(r[: len(by)])] = m + np.triu(m, 1).T
    return out


def crossval_predict(
    estimator, df: DataFrame, features: list[str], target: str, id_col: str, cv: int = 5, fold_col: str | None = None, method: str = "predict", sample_weight: str | None = None, compute_confidence_interval: bool = False, n_iterations_boostrap: int | None = None, bootstrap_size: float | None = None, alpha: float | None = None, seed: int = 0
) -> DataFrame:
    """One row per row without missing values: id, fold, prediction by a model that hasn't seen its fold and, if asked for, lower and
    upper bounds at coverage alpha over bootstrap refits (each row counts a Poisson number of times, bootstrap_size on average).

    Folds come from a hash of the id, or from fold_col. Least squares takes two aggregations for all folds and refits.
    """
    require(df, [*features, target, id_col])
    rows = drop_missing(nan_to_null(df), [*features, target])
    rows = rows.withColumn("_fold", col(fold_col).cast("int") if fold_col else fold_of(id_col, cv, seed))
    if compute_confidence_interval and None in (n_iterations_boostrap, bootstrap_size, alpha):
        raise ValueError("a confidence interval needs n_iterations_boostrap, bootstrap_size and alpha")
    if not isinstance(estimator, LeastSquaresEstimator) or type(estimator) is not LeastSquaresEstimator:
        if compute_confidence_interval:
            return _refits(estimator, rows, features, target, id_col, method, sample_weight, n_iterations_boostrap, bootstrap_size, alpha, seed)
        return _refits(estimator, rows, features, target, id_col, method, sample_weight, 0, 1.0, 0.95, seed)
    w = col(sample_weight).cast("double") if sample_weight else F.lit(1.0)
    own = list(map(col, [id_col, *features, target]))  # the id may repeat
    k = len(features)
    sums = {f[0]: m for f, m in _grouped_fits(rows, features, target, ["_fold"], w).items()}
    whole = sum(sums.values())
    x = F.array(*(col(f).cast("double") for f in features))

    def dot(b: Column) -> Column:
        return F.aggregate(F.zip_with(x, b, lambda p, q: p * q), F.lit(0.0), lambda a, y: a + y)

    def betas(by: dict) -> Column:
        """A map from fold to coefficients."""
        return F.create_map(*(z for f, m in by.items() for z in (F.lit(f), F.array(*(F.lit(float(v)) for v in solve(m[:k, :k], m[:k, k])[0])))))

    out = [col(id_col), F.col("_fold").alias("fold"), dot(betas({f: whole - m for f, m in sums.items()})[F.col("_fold")]).alias("prediction")]
    if compute_confidence_interval:
        draws = rows.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(n_iterations_boostrap - 1))))
        drawn = _grouped_fits(draws, features, target, ["_fold", "_draw"], w * poisson_weight(bootstrap_size, *own, F.col("_draw"), F.lit(seed)))
        folds, all_ = sorted(sums), {}
        for d in range(n_iterations_boostrap):
            parts = {f: drawn.get((f, d), np.zeros((k + 1, k + 1))) for f in folds}
            total = sum(parts.values())
            for f in folds:
                m = total - parts[f]
                all_.setdefault(f, []).append(solve(m[:k, :k], m[:k, k])[0])
        table = F.create_map(*(z for f in folds for z in (F.lit(f), F.array(*(F.array(*(F.lit(float(v)) for v in b)) for b in all_[f])))))
        spread = F.array_sort(F.transform(table[F.col("_fold")], dot))
        out += [_at(spread, (1 - alpha) / 2, n_iterations_boostrap).alias("lower"), _at(spread, (1 + alpha) / 2, n_iterations_boostrap).alias("upper")]
    return rows.select(*out)


def _at(values: Column, q: float, n: int) -> Column:
    """A linearly interpolated quantile of a sorted array of n."""
    place = q * (n - 1)
    low = math.floor(place)
    high = min(low + 1, n - 1)
    return F.get(values, F.lit(low)) * (1 - (place - low)) + F.get(values, F.lit(high)) * (place - low)


def _refits(estimator, rows, features, target, id_col, method, sample_weight, n_boot, size, alpha, seed) -> DataFrame:
    """Any estimator: a fit for each fold (and draw), predictions as long rows."""
    folds = sorted(r[0] for r in rows.select("_fold").distinct().collect())
    parts = []
    for f in folds:
        train, test = rows.filter(F.col("_fold") != f), rows.filter(F.col("_fold") == f)

        def fitted(data, weight):
            e = copy.deepcopy(estimator)
            e.fit(data, features, target, sample_weight=weight)
            return e

        def column(e):
            if method == "predict_proba":
                return e.probability()
            return (e.probability() >= e.proba_threshold).cast("double") if hasattr(e, "probability") and e.proba_threshold else e.probability() if hasattr(e, "probability") else e.predict(test, "_p")

        model = fitted(train, sample_weight)
        out = [col(id_col), F.col("_fold").alias("fold"), column(model).alias("prediction")]
        if n_boot:
            w = col(sample_weight).cast("double") if sample_weight else F.lit(1.0)
            draws = [column(fitted(train.withColumn("_bw", w * poisson_weight(size, *map(col, [id_col, *features, target]), F.lit(d), F.lit(seed))).filter("_bw > 0"), "_bw")) for d in range(n_boot)]
            spread = F.array_sort(F.array(*draws))
            out += [_at(spread, (1 - alpha) / 2, n_boot).alias("lower"), _at(spread, (1 + alpha) / 2, n_boot).alias("upper")]
        parts.append(test.select(*out))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
