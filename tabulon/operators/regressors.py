"""Least squares, weighted or with fixed effects, from sums of products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, drop_missing, nan_to_null, require
from ..functions.distributions import t_quantile, t_two_sided
from ..functions.lineage import cut
from ..functions.moments import gram, solve

MAX_TIMES = 40
SUMMARY = ("Coefficients", "P-valeurs", "ICg", "ICd")


def linear(coefficients: dict[str, float]) -> Column:
    return sum((col(c).cast("double") * F.lit(float(b)) for c, b in coefficients.items()), F.lit(0.0))


def summary_frame(spark, names, coef, p, low, high) -> DataFrame:
    rows = [(n, *(float(x[i]) for x in (coef, p, low, high))) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "variable string, " + ", ".join(f"`{c}` double" for c in SUMMARY))


class LeastSquaresEstimator:
    """OLS, or WLS with a weight column. No intercept is added: use AddConstante."""

    def __init__(self, alpha: float = 0.05):
        self.alpha = alpha

    def get_params(self) -> dict:
        return {"alpha": self.alpha}

    def set_params(self, **params):
        for k, v in params.items():
            setattr(self, k, v)
        return self

    def fit(self, df: DataFrame, features: list[str], target: str, sample_weight: str | None = None):
        require(df, [*features, target, *([sample_weight] if sample_weight else [])])
        self.spark, self.features, self.target = df.sparkSession, list(features), target
        rows = drop_missing(nan_to_null(df), [*features, target, *([sample_weight] if sample_weight else [])])
        m = gram(rows, [*map(col, features), col(target)], col(sample_weight) if sample_weight else None)
        return self._solve(m)

    def _solve(self, m):
        k = len(self.features)
        raw = m.raw
        flat = [i for i in range(k) if m.centred[i, i] <= 1e-12 * max(raw[i, i], 1e-300) and m.mean[i] != 0]
        self.n = m.n
        if flat:
            # with a constant: slopes from centred products, then the constant from the means
            c, rest = flat[0], [i for i in range(k) if i not in flat]
            beta, inv = np.zeros(k), np.zeros((k, k))
            slope, part, rank = solve(m.centred[np.ix_(rest, rest)], m.centred[rest, k]) if rest else (np.zeros(0), np.zeros((0, 0)), 0)
            beta[rest] = slope
            beta[c] = (m.mean[k] - m.mean[rest] @ slope) / m.mean[c]
            inv[np.ix_(rest, rest)] = part
            inv[c, rest] = inv[rest, c] = -(part @ m.mean[rest]) / m.mean[c]
            inv[c, c] = (1 / m.weight + m.mean[rest] @ part @ m.mean[rest]) / m.mean[c] ** 2
            ssr = max(0.0, m.centred[k, k] - 2 * slope @ m.centred[rest, k] + slope @ m.centred[np.ix_(rest, rest)] @ slope)
            rank += 1
            self.centred = True
        else:
            beta, inv, rank = solve(raw[:k, :k], raw[:k, k])
            ssr = max(0.0, raw[k, k] - 2 * beta @ raw[:k, k] + beta @ raw[:k, :k] @ beta)
            ones = m.weight * m.mean[:k]
            self.centred = bool(m.weight and abs(ones @ inv @ ones - m.weight) < 1e-9 * m.weight)
        self.total = m.centred[k, k] if self.centred else raw[k, k]
        self.rank, self.df_resid, self.ssr = rank, m.n - rank, ssr
        self.scale = ssr / self.df_resid if self.df_resid > 0 else float("nan")
        self.coefficients, self.covariance = dict(zip(self.features, beta, strict=True)), inv * self.scale
        return self

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, linear(self.coefficients))

    def inference(self):
        b = np.array(list(self.coefficients.values()))
        se = np.sqrt(np.clip(np.diag(self.covariance), 0, None))
        t = np.divide(b, se, out=np.full_like(b, np.inf), where=se > 0)
        q = t_quantile(1 - self.alpha / 2, self.df_resid)
        return b, np.array([t_two_sided(float(x), self.df_resid) for x in t]), b - q * se, b + q * se

    def summary(self) -> DataFrame:
        """variable, Coefficients, P-valeurs, ICg, ICd."""
        return summary_frame(self.spark, self.features, *self.inference())

    def rsquared(self) -> DataFrame:
        """R2 (centred if the columns span a constant) and R2Adj."""
        r2 = 1 - self.ssr / self.total if self.total else float("nan")
        free = self.n - (1 if self.centred else 0)
        adj = 1 - (1 - r2) * free / self.df_resid if self.df_resid > 0 else float("nan")
        return self.spark.createDataFrame([(float(r2), float(adj))], "R2 double, R2Adj double")


class PanelLeastSquaresEstimator(LeastSquaresEstimator):
    """Least squares with entity and time effects, after the within transformation. Columns that the effects absorb raise
    ValueError, or go with drop_absorbed. Of two effects, that of time becomes dummies up to MAX_TIMES times; beyond, both are taken out in turn."""

    def __init__(self, entity_effects: bool = False, time_effects: bool = False, drop_absorbed: bool = False, check_rank: bool = True, cov_type: str = "unadjusted", alpha: float = 0.05, tolerance: float = 1e-10, max_rounds: int = 100):
        super().__init__(alpha)
        if cov_type not in ("unadjusted", "robust"):
            raise ValueError("cov_type must be unadjusted or robust")
        self.entity_effects, self.time_effects, self.drop_absorbed, self.check_rank, self.cov_type = entity_effects, time_effects, drop_absorbed, check_rank, cov_type
        self.tolerance, self.max_rounds = tolerance, max_rounds

    def _minus_means(self, df: DataFrame, by: str, names: list[str]) -> DataFrame:
        """Means are aggregated and joined back: an entity with very many rows is split like any skewed key."""
        means = df.groupBy(col(by).alias("_by")).agg(*((F.sum(F.col(n) * F.col("_w")) / F.sum("_w")).alias(f"_m{i}") for i, n in enumerate(names)))
        at = {n: i for i, n in enumerate(names)}
        return df.join(means, col(by).eqNullSafe(F.col("_by"))).select(*((F.col(c) - F.col(f"_m{at[c]}")).alias(c) if c in at else col(c) for c in df.columns))

    def _within(self, df: DataFrame, names: list[str]) -> DataFrame:
        if self.entity_effects and self.time_effects:
            times = [r[0] for r in df.select(col(self.time)).distinct().limit(MAX_TIMES + 1).collect()]
            return self._with_dummies(df, names, sorted(times)[1:]) if len(times) <= MAX_TIMES else self._in_turn(df, names)
        if self.entity_effects:
            return self._minus_means(df, self.entity, names)
        return self._minus_means(df, self.time, names) if self.time_effects else df

    def _with_dummies(self, df: DataFrame, names: list[str], times: list) -> DataFrame:
        """Deviations from entity means, less what dummies of the times (in deviations too) explain of them: exact in one round."""
        flags = [f"_d{i}" for i in range(len(times))]
        inner = self._minus_means(df.select("*", *((col(self.time) == F.lit(x)).cast("double").alias(f) for f, x in zip(flags, times, strict=True))), self.entity, [*names, *flags])
        raw = gram(inner, [F.col(c) for c in (*flags, *names)], F.col("_w")).raw
        k = len(flags)
        part = {n: solve(raw[:k, :k], raw[:k, k + i])[0] for i, n in enumerate(names)} if k else {}
        return inner.select(*((F.col(c) - sum((F.col(f) * F.lit(float(g)) for f, g in zip(flags, part.get(c, []), strict=False)), F.lit(0.0))).alias(c) if c in names else col(c) for c in df.columns))

    def _in_turn(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Both means taken out in turn until nothing moves, each round cut off by a checkpoint."""
        scale = [x or 1.0 for x in df.agg(*(F.stddev_pop(n) for n in names)).first()]
        for _ in range(self.max_rounds):
            df = cut(self._minus_means(self._minus_means(df, self.entity, names), self.time, names))
            left = df.groupBy(col(self.entity)).agg(*(F.abs(F.sum(F.col(n) * F.col("_w")) / F.sum("_w")).alias(n) for n in names)).agg(*(F.max(n) for n in names)).first()
            if max((x or 0.0) / s for x, s in zip(left, scale, strict=True)) <= self.tolerance:
                return df
        raise ValueError(f"the effects didn't settle in {self.max_rounds} rounds")

    def fit(self, df: DataFrame, features: list[str], target: str, entity_col: str, time_col: str, sample_weight: str | None = None):
        require(df, [*features, target, entity_col, time_col])
        self.spark, self.entity, self.time = df.sparkSession, "_entity", "_time"
        w = col(sample_weight).cast("double") if sample_weight else F.lit(1.0)
        rows = drop_missing(nan_to_null(df), [*features, target, entity_col, time_col])
        rows = rows.select(col(entity_col).alias("_entity"), col(time_col).alias("_time"), w.alias("_w"), *(col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)), col(target).cast("double").alias("_y"))
        names = [*(f"_x{i}" for i in range(len(features))), "_y"]
        self.rows, self.names = rows, names
        effects = self.entity_effects or self.time_effects
        before = gram(rows, [F.col(n) for n in names], F.col("_w"))
        self.inside = self._within(rows.select("*", *(F.col(n).alias(f"{n}o") for n in names)), names)
        m = gram(self.inside, [F.col(n) for n in names], F.col("_w"))
        keep = list(range(len(features)))
        if effects:
            gone = [i for i in keep if m.raw[i, i] <= 1e-9 * max(before.raw[i, i], 1e-300)]
            if gone and not self.drop_absorbed:
                raise ValueError(f"absorbed by the effects: {[features[i] for i in gone]}")
            keep = [i for i in keep if i not in gone]
        at = [*keep, len(features)]
        raw = m.raw[np.ix_(at, at)]
        k = len(keep)
        beta, inv, rank = solve(raw[:k, :k], raw[:k, k])
        if self.check_rank and rank < k:
            raise ValueError("the features don't have full rank")
        self.features, self.target, self.n = [features[i] for i in keep], target, m.n
        self.kept = keep
        self.coefficients = dict(zip(self.features, beta, strict=True))
        self.ssr = max(0.0, raw[k, k] - 2 * beta @ raw[:k, k] + beta @ raw[:k, :k] @ beta)
        ones = before.weight * before.mean[keep]
        inner, innerinv, _ = solve(before.raw[np.ix_(keep, keep)], ones)
        self.has_constant = bool(not effects and before.weight and abs(ones @ innerinv @ ones - before.weight) < 1e-9 * before.weight)
        count = self.rows.agg(F.count_distinct("_entity"), F.count_distinct("_time")).first()
        absorbed = (count[0] if self.entity_effects else 0) + (count[1] if self.time_effects else 0) - (1 if self.entity_effects and self.time_effects else 0)
        self.df_resid = m.n - rank - absorbed
        self.scale = self.ssr / self.df_resid if self.df_resid > 0 else float("nan")
        self.covariance = inv * self.scale
        if self.cov_type == "robust":
            e = F.col("_y") - sum((F.col(f"_x{i}") * F.lit(float(b)) for i, b in zip(keep, beta, strict=True)), F.lit(0.0))
            meat = gram(self.inside, [F.col(f"_x{i}") * e * F.sqrt("_w") for i in keep], F.col("_w")).raw
            self.covariance = inv @ meat @ inv * m.n / self.df_resid
        self.inside_total = raw[k, k] if effects or not self.has_constant else m.centred[-1, -1]
        self.all_total = before.centred[-1, -1] if effects or self.has_constant else before.raw[-1, -1]
        self.before = before
        return self

    def rsquared(self) -> DataFrame:
        """n_observations and five kinds of R2, from residual and total sums of squares of the data, of entity means and of deviations from them."""
        k = self.kept
        b = np.array([self.coefficients[f] for f in self.features])

        def ratio(m, centred):
            g = m.centred if centred else m.raw
            at = [*k, len(g) - 1]
            g = g[np.ix_(at, at)]
            v = np.r_[-b, 1.0]
            r = m.raw[np.ix_(at, at)]
            return 1 - (v @ r @ v) / g[-1, -1] if g[-1, -1] else float("nan")

        cols = [F.col(n) for n in self.names]
        means = self.rows.groupBy("_entity").agg(*((F.sum(F.col(n) * F.col("_w")) / F.sum("_w")).alias(n) for n in self.names), F.avg("_w").alias("_w"))
        within = self._minus_means(self.rows, "_entity", self.names)
        out = (
            float(self.n),
            1 - self.ssr / self.inside_total if self.inside_total else float("nan"),
            1 - self.ssr / self.all_total if self.all_total else float("nan"),
            ratio(self.before, self.has_constant),
            ratio(gram(means, cols, F.col("_w")), self.has_constant),
            ratio(gram(within, cols, F.col("_w")), False),
        )
        names = ("n_observations", "R2", "R2 - Effets fixes inclus", "R2 - Effets fixes exclus", "R2 - Purgé des effets temporels", "R2 - Purgé des effets individuels")
        return self.spark.createDataFrame([tuple(map(float, out))], ", ".join(f"`{n}` double" for n in names))

    def estimated_effects(self) -> DataFrame:
        """entity, time and the sum of their effects for each row: what y has beyond the features and the residual."""
        at = list(zip(self.kept, self.coefficients.values(), strict=True))
        outer = F.col("_yo") - sum((F.col(f"_x{i}o") * F.lit(float(b)) for i, b in at), F.lit(0.0))
        inner = F.col("_y") - sum((F.col(f"_x{i}") * F.lit(float(b)) for i, b in at), F.lit(0.0))
        return self.inside.select(F.col("_entity").alias("entity"), F.col("_time").alias("time"), (outer - inner).alias("estimated_effects"))


class OaxacaBlinder:
    """Decomposition of the gap between the means of group 1 and group 0, with coefficients of pooled rows or of the reference group (method "other")."""

    def __init__(self, bifurcate: str, method: str = "pooled"):
        if method not in ("pooled", "other"):
            raise ValueError('method must be "pooled" or "other"')
        self.bifurcate, self.method = bifurcate, method

    def fit(self, df: DataFrame, features: list[str], target: str, sample_weight: str | None = None):
        require(df, [*features, target, self.bifurcate])
        rows = drop_missing(nan_to_null(df), [*features, target, self.bifurcate])
        flag = col(self.bifurcate).cast("int")
        self.features, self.spark = list(features), df.sparkSession
        self.model = LeastSquaresEstimator().fit(rows if self.method == "pooled" else rows.filter(flag == 1), features, target, sample_weight)
        w = col(sample_weight).cast("double") if sample_weight else F.lit(1.0)
        names = [*features, target]
        means = {r["_f"]: r for r in rows.groupBy(flag.alias("_f")).agg(*(F.try_divide(F.sum(col(c) * w), F.sum(w)).alias(f"_{i}") for i, c in enumerate(names))).collect()}
        if set(means) != {0, 1}:
            raise ValueError("both groups, 0 and 1, must have rows")
        self.gaps = {c: float(means[1][f"_{i}"] - means[0][f"_{i}"]) for i, c in enumerate(names)}
        self.gap = self.gaps.pop(target)
        return self

    def decompose(self, detailed: bool = False) -> DataFrame:
        parts = {c: self.gaps[c] * self.model.coefficients[c] for c in self.features}
        if detailed:
            return self.spark.createDataFrame([(c, float(v)) for c, v in parts.items()], "variable string, `explained effect` double")
        explained = float(sum(parts.values()))
        rows = [("Unexplained Effect", self.gap - explained), ("Explained Effect", explained), ("Gap", self.gap)]
        return self.spark.createDataFrame(rows, "effect string, decomposition double")

    def summary(self) -> DataFrame:
        return self.model.summary()

    def rsquared(self) -> DataFrame:
        return self.model.rsquared()


