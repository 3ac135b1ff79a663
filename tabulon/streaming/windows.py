"""The algebraic statistics over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require


def windowed_statistics(stream: DataFrame, time_col: str, window: str, values: list[str], keys: list[str] | None = None, weight: str | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Sum, mean and count of values by window and keys; weighted if a weight is named. late is the watermark's delay. Works on batches too."""
    keys = keys or []
    require(stream, [time_col, *values, *keys, *([weight] if weight else [])])
    df = stream.withColumn("_at", col(time_col).cast("timestamp"))
    df = df.withWatermark("_at", late) if late else df
    w = col(weight).cast("double") if weight else F.lit(1.0)
    aggs = []
    for v in values:
        x = col(v).cast("double")
        mean = F.try_divide(F.coalesce(F.sum(x * w), F.lit(0.0)), F.sum(w)) if weight else F.avg(x)
        aggs += [F.coalesce(F.sum(x * w), F.lit(0.0)).alias(f"{v}_sum"), mean.alias(f"{v}_mean"), F.count(x).alias(f"{v}_count")]
    out = df.groupBy(F.window("_at", window, slide).alias("_window"), *map(col, keys)).agg(*aggs)
    return out.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *map(col, keys), *(col(f"{v}_{s}") for v in values for s in ("sum", "mean", "count")))
