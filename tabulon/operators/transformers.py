"""Feature transformers: fit(df), transform(df), fit_transform(df), and inverse_transform(df) where there is one."""

from __future__ import annotations

from itertools import product
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SEPARATOR, col, drop_missing, nan_to_null, require

MAX_MODALITIES = 1000


class Transformer(Protocol):
    def fit(self, df: DataFrame): ...

    def transform(self, df: DataFrame) -> DataFrame: ...


class _Fitted:
    def fit(self, df: DataFrame):
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def modalities(df: DataFrame, names: list[str], limit: int = MAX_MODALITIES) -> dict[str, list]:
    """Sorted distinct values of some columns (they become columns, so their number is limited; more raise ValueError)."""
    require(df, names)
    out = {}
    df = nan_to_null(df.select(*map(col, names)))
    for n in names:
        got = [r[0] for r in df.select(col(n)).where(col(n).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(got) > limit:
            raise ValueError(f"{n} has over {limit} modalities")
        out[n] = sorted(got)
    return out


def _is(name: str, modality) -> Column:
    return F.coalesce(col(name) == F.lit(modality), F.lit(False))


class OneHotEncoder(_Fitted):
    """Columns become dummies "column - modality" (sorted, after the other columns). Modalities that fit() hasn't seen have none; dummy_na adds "column - nan"."""

    def __init__(self, columns: list[str], dummy_na: bool = False, dtype: type = bool):
        kinds = {bool: "boolean", int: "int", float: "double"}
        if dtype not in kinds:
            raise ValueError("dtype must be bool, int or float")
        self.columns, self.dummy_na, self.kind = list(columns), dummy_na, kinds[dtype]

    def fit(self, df: DataFrame):
        self.modalities = modalities(df, self.columns)
        self.source = [f for f in df.schema.fields if f.name in self.columns]
        return self

    def names(self) -> list[tuple[str, object, str]]:
        """(column, modality or None for missing, dummy)."""
        out = []
        for c in self.columns:
            out += [(c, m, f"{c}{SEPARATOR}{m}") for m in self.modalities[c]]
            if self.dummy_na:
                out.append((c, None, f"{c}{SEPARATOR}nan"))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.columns)
        df = nan_to_null(df)
        made = [(col(c).isNull() if m is None else _is(c, m)).cast(self.kind).alias(n) for c, m, n in self.names()]
        return df.select(*(col(c) for c in df.columns if c not in self.columns), *made)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """The columns again: for each the modality of its largest dummy, the first of equal ones."""
        by: dict[str, list] = {}
        for c, m, n in self.names():
            by.setdefault(c, []).append((m, n))
        require(df, [n for _, _, n in self.names()])
        dummies = {n for _, _, n in self.names()}
        kinds = {f.name: f.dataType for f in self.source}
        back = []
        for c in self.columns:
            flags = F.array(*(col(n).cast("double") for _, n in by[c]))
            labels = F.array(*(F.lit(m).cast(kinds[c]) for m, _ in by[c]))
            back.append(F.get(labels, F.array_position(flags, F.array_max(flags)).cast("int") - 1).alias(c))
        return df.select(*(col(c) for c in df.columns if c not in dummies), *back)


class StandardScalerTransformer(_Fitted):
    """(x - mean) / population deviation, of all columns or some; a deviation of 0 counts as 1."""

    def __init__(self, columns: list[str] | None = None):
        self.columns = columns

    def fit(self, df: DataFrame):
        self.used = list(self.columns or df.columns)
        require(df, self.used)
        row = nan_to_null(df).agg(*(f(col(c)) for c in self.used for f in (F.avg, F.stddev_pop))).first()
        self.scale = {c: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, c in enumerate(self.used)}
        return self

    def _map(self, df: DataFrame, f) -> DataFrame:
        require(df, self.used)
        return df.select(*(f(col(c).cast("double"), *self.scale[c]).alias(c) if c in self.scale else col(c) for c in df.columns))

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda c, m, s: (c - m) / s)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda c, m, s: c * s + m)


class LogTransformer(_Fitted):
    """Natural logarithm in place; that of 0 is replace_inf (minus infinity if that is a bool), that of negatives null."""

    def __init__(self, list_col: list[str], replace_inf: float | bool = 0):
        self.list_col, self.replace_inf = list(list_col), replace_inf

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.list_col)
        df = nan_to_null(df)
        zero = F.lit(float("-inf") if isinstance(self.replace_inf, bool) else float(self.replace_inf))
        x = {c: F.when(col(c) == 0, zero).when(col(c) > 0, F.ln(col(c).cast("double"))) for c in self.list_col}
        return df.select(*(x[c].alias(c) if c in x else col(c) for c in df.columns))


class AddConstante(_Fitted):
    """A column of ones."""

    def __init__(self, name: str = "Constante"):
        self.name = name

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, F.lit(1))


class AddFixedEffect(_Fitted):
    """Dummies of a column, named by its modalities alone, after all columns (which stay), without the reference modality."""

    def __init__(self, x_categorie: str, no_trap: str | None = None):
        self.x_categorie, self.no_trap = x_categorie, no_trap

    def fit(self, df: DataFrame):
        self.modalities = [m for m in modalities(df, [self.x_categorie])[self.x_categorie] if m != self.no_trap]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *(_is(self.x_categorie, m).cast("int").alias(str(m)) for m in self.modalities))


class AddInteraction(_Fitted):
    """Products of dummies "a - b" for every combination of modalities, seen together or not, without the reference ones."""

    def __init__(self, list_x_categorie: list[str], list_no_trap: list[str] | None = None):
        self.list_x_categorie, self.list_no_trap = list(list_x_categorie), list(list_no_trap or [])

    def fit(self, df: DataFrame):
        found = modalities(df, self.list_x_categorie)
        self.combinations = list(product(*([m for m in found[c] if m not in self.list_no_trap] for c in self.list_x_categorie)))
        if len(self.combinations) > MAX_MODALITIES:
            raise ValueError(f"over {MAX_MODALITIES} combinations")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = []
        for combo in self.combinations:
            both = F.lit(True)
            for c, m in zip(self.list_x_categorie, combo, strict=True):
                both = both & _is(c, m)
            made.append(both.cast("int").alias(SEPARATOR.join(map(str, combo))))
        return df.select("*", *made)


class ClusteringTransformer(_Fitted):
    """Labels of a clusterer of pyspark.ml over all columns or some, put first. Labels are numbered by the sorted centres where the model has any.

    A weight column is used if the clusterer takes one.
    """

    def __init__(self, estimator=None, sample_weight: str | None = None, columns: list[str] | None = None):
        self.estimator, self.sample_weight, self.columns = estimator, sample_weight, columns

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        require(df, self.used)
        return df.withColumn("_features", array_to_vector(F.array(*(col(c).cast("double") for c in self.used))))

    def fit(self, df: DataFrame):
        from pyspark.ml.clustering import KMeans

        self.used = list(self.columns or (c for c in df.columns if c != self.sample_weight))
        est = (self.estimator or KMeans(k=2, seed=42)).copy()
        est.setFeaturesCol("_features")
        if self.sample_weight and est.hasParam("weightCol"):
            est.setWeightCol(self.sample_weight)
        self.model = est.fit(self._assembled(drop_missing(nan_to_null(df), self.used)))
        centers = [tuple(map(float, c)) for c in self.model.clusterCenters()] if hasattr(self.model, "clusterCenters") else []
        rank = {old: new for new, (_, old) in enumerate(sorted((c, i) for i, c in enumerate(centers)))}
        self.rank = rank
        return self

    def _labelled(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._assembled(drop_missing(nan_to_null(df), self.used)))
        label = col(self.model.getPredictionCol())
        if self.rank:
            label = F.get(F.array(*(F.lit(self.rank[i]) for i in range(len(self.rank)))), label.cast("int"))
        return out.withColumn("labels", label.cast("int"))

    def transform(self, df: DataFrame) -> DataFrame:
        return self._labelled(df).select("labels", *map(col, df.columns))

    def predict(self, df: DataFrame) -> DataFrame:
        return self._labelled(df).select("labels")


