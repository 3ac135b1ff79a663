"""Estimation from raw columns to summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import col, drop_missing, nan_to_null, require


def estimate_summarize(estimator, df: DataFrame, features: list[str], target: str, transformer=None, excluder=None, sample_weight: str | None = None, **fit) -> tuple[DataFrame, DataFrame]:
    """(summary, rsquared) of the estimator, after: rows without missing features, transformer, rows without a missing
    target, excluder, positive weights. The features are those that the transformer and the excluder leave."""
    others = [target, *([sample_weight] if sample_weight else []), *(v for v in fit.values() if isinstance(v, str))]
    require(df, [*features, *others])
    rows = drop_missing(nan_to_null(df).select(*map(col, dict.fromkeys([*features, *others]))), features)
    held = [c for c in others if c not in features]
    if transformer is not None:
        rows = transformer.fit_transform(rows)
    rows = drop_missing(rows)
    if excluder is not None:
        rows = excluder.fit_transform(rows)
    if sample_weight:
        rows = rows.filter(col(sample_weight) > 0)
    left = [c for c in rows.columns if c not in held]
    estimator.fit(rows, left, target, sample_weight=sample_weight, **fit)
    return estimator.summary(), estimator.rsquared()
