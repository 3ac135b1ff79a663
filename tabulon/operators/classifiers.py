"""Logit and probit by Newton steps: each step is one aggregation over the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, drop_missing, nan_to_null, require
from ..functions.distributions import normal_cdf, normal_pdf, normal_quantile, normal_two_sided
from ..functions.moments import partial_sums, solve
from ..functions.weighted import running_sum_before
from .regressors import linear, summary_frame


class _Classifier:
    """No intercept is added: use AddConstante. regularized adds an L1 penalty alpha to the negative log-likelihood, solved by
    proximal Newton steps; coefficients under size_trim_tol are then 0. converged tells whether the steps ended by themselves (perfect separation never does)."""

    def __init__(self, proba_threshold: float | None = 0.5, scoring: str = "roc", regularized: bool = False, method: str = "l1", alpha: float = 0.01, max_iter: int = 50, tolerance: float = 1e-10, size_trim_tol: float = 1e-4):
        if scoring not in ("roc", "accuracy"):
            raise ValueError('scoring must be "roc" or "accuracy"')
        if method != "l1":
            raise ValueError('method must be "l1"')
        self.proba_threshold, self.scoring, self.regularized, self.method, self.alpha = proba_threshold, scoring, regularized, method, alpha
        self.max_iter, self.tolerance, self.size_trim_tol = max_iter, tolerance, size_trim_tol

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in ("proba_threshold", "scoring", "regularized", "method", "alpha")}

    def set_params(self, **params):
        for k, v in params.items():
            if k not in self.get_params():
                raise ValueError(f"no parameter {k}")
            setattr(self, k, v)
        return self

    def fit(self, df: DataFrame, features: list[str], target: str, sample_weight: str | None = None):
        require(df, [*features, target])
        self.spark, self.features, self.target = df.sparkSession, list(features), target
        rows = drop_missing(nan_to_null(df), [*features, target, *([sample_weight] if sample_weight else [])])
        columns = [*map(col, features), col(target).cast("double"), col(sample_weight) if sample_weight else F.lit(1.0)]
        k = len(features)
        # each step reads the rows anew: keep the few columns that it needs; a lost part is made again
        held = rows.select(*(c.cast("double").alias(f"_{i}") for i, c in enumerate(columns))).persist()
        try:
            self._steps(held, k)
        finally:
            held.unpersist()
        self.mean_rows = rows
        return self

    def _steps(self, held: DataFrame, k: int) -> None:
        columns = [F.col(c) for c in held.columns]
        terms = self._terms
        beta = np.zeros(k)
        self.converged, last, step = False, None, None
        for _ in range(self.max_iter):

            def sums(m, b=beta):
                x, y, w = m[:, :k], m[:, k], m[:, k + 1]
                ll, g, h = terms(x @ b, y)
                return np.r_[(w * ll).sum(), x.T @ (w * g), ((x * (w * h)[:, None]).T @ x).ravel()]

            got = partial_sums(held, columns, sums).get(())
            if got is None:
                raise ValueError("no rows to fit on")
            value, g, h = got[0], got[1 : k + 1], got[k + 1 :].reshape(k, k)
            if self.regularized:
                value -= self.alpha * np.abs(beta).sum()
            if last is not None and value < last - 1e-9 * abs(last) and step is not None:
                # too far: halve the step
                step = step / 2
                beta = beta - step
                if np.abs(step).max() < 1e-12:
                    break
                continue
            self.log_likelihood, self.information = float(got[0]), h
            new = self._lasso(h, g, beta) if self.regularized else beta + solve(h, g)[0]
            step, last = new - beta, value
            if np.abs(step).max() <= self.tolerance * max(1.0, np.abs(beta).max()):
                self.converged = True
                break
            beta = new
        if self.regularized:
            beta = np.where(np.abs(beta) < self.size_trim_tol, 0.0, beta)
        self.coefficients = dict(zip(self.features, map(float, beta), strict=True))
        self.covariance = solve(self.information, np.zeros(k))[1]

    def _lasso(self, h, g, beta):
        """Minimum of the quadratic model with the penalty, by coordinates."""
        new = beta.copy()
        for _ in range(1000):
            before = new.copy()
            for j in range(len(new)):
                if h[j, j] <= 0:
                    continue
                r = g[j] - h[j] @ (new - beta) + h[j, j] * new[j]
                new[j] = np.sign(r) * max(abs(r) - self.alpha, 0.0) / h[j, j]
            if np.abs(new - before).max() < 1e-12:
                break
        return new

    def probability(self) -> Column:
        raise NotImplementedError

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with proba_0 and proba_1."""
        p = self.probability()
        return df.withColumn("proba_1", p).withColumn("proba_0", 1 - F.col("proba_1")).select(*map(col, df.columns), "proba_0", "proba_1")

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The class, 1 from the threshold on; the probability if there is no threshold (None or 0)."""
        p = self.probability()
        return df.withColumn(output, (p >= self.proba_threshold).cast("int") if self.proba_threshold else p)

    def score(self, df: DataFrame, target: str | None = None, on: str = "predict") -> float:
        """Accuracy, or the area under the ROC curve of what predict gives (on="proba": of the probabilities)."""
        y = col(target or self.target).cast("double")
        p = self.probability()
        if self.scoring == "accuracy":
            label = (p >= (self.proba_threshold or 0.5)).cast("double")
            return float(nan_to_null(df).agg(F.avg((label == y).cast("double"))).first()[0])
        if on == "predict" and self.proba_threshold:
            label = (p >= self.proba_threshold).cast("double")
            r = df.agg(F.avg(F.when(y == 1, label)), F.avg(F.when(y == 0, 1 - label))).first()
            return float((r[0] + r[1]) / 2)
        # ranks by distinct score: counts first, then a running sum in two levels
        by = df.select(p.alias("p"), y.alias("y")).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        r = running_sum_before(by, [], "p", "neg").agg(F.sum(F.col("pos") * (F.col("_before") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).first()
        return float(r[0])

    def cov_matrix(self) -> DataFrame:
        rows = [(n, *map(float, self.covariance[i])) for i, n in enumerate(self.features)]
        return self.spark.createDataFrame(rows, "variable string, " + ", ".join(f"`{f}` double" for f in self.features))

    def summary(self) -> DataFrame:
        b = np.array(list(self.coefficients.values()))
        se = np.sqrt(np.clip(np.diag(self.covariance), 0, None))
        z = np.divide(b, se, out=np.full_like(b, np.inf), where=se > 0)
        q = normal_quantile(0.975)
        return summary_frame(self.spark, self.features, b, [normal_two_sided(float(x)) for x in z], b - q * se, b + q * se)

    def rsquared(self) -> DataFrame:
        """Log-likelihood and whether the steps converged."""
        return self.spark.createDataFrame([(self.log_likelihood, self.converged)], "log_likelihood double, converged boolean")


class LogitClassifier(_Classifier):
    @staticmethod
    def _terms(z, y):
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return y * z - np.logaddexp(0, z), y - p, p * (1 - p)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-linear(self.coefficients)))

    def margeff(self) -> DataFrame:
        """Average marginal effects with delta-method errors; constant columns have none."""
        k, b = len(self.features), np.array(list(self.coefficients.values()))

        def sums(m):
            z = m @ b
            p = 1 / (1 + np.exp(-z))
            d = p * (1 - p)
            return np.r_[len(m), d.sum(), m.T @ (d * (1 - 2 * p)), m.min(axis=0) if len(m) else np.zeros(k)][: k + 2]

        got = partial_sums(self.mean_rows, list(map(col, self.features)), sums)[()]
        spread = self.mean_rows.agg(*(F.max(col(f)) > F.min(col(f)) for f in self.features)).first()
        n, d, third = got[0], got[1] / got[0], got[2:] / got[0]
        effect = d * b
        jacobian = d * np.eye(k) + np.outer(b, third)
        se = np.sqrt(np.clip(np.diag(jacobian @ self.covariance @ jacobian.T), 0, None))
        q = normal_quantile(0.975)
        rows = [(f, float(effect[i]), float(se[i]), float(effect[i] / se[i]) if se[i] else float("inf"), normal_two_sided(float(effect[i] / se[i])) if se[i] else 0.0, float(effect[i] - q * se[i]), float(effect[i] + q * se[i])) for i, f in enumerate(self.features) if spread[i]]
        return self.spark.createDataFrame(rows, "variable string, `dy/dx` double, `Std. Err.` double, z double, `Pr(>|z|)` double, `Conf. Int. Low` double, `Cont. Int. Hi.` double")


class ProbitClassifier(_Classifier):
    @staticmethod
    def _terms(z, y):
        q = 2 * y - 1
        cdf = np.clip(normal_cdf(q * z), 1e-300, None)
        ratio = q * normal_pdf(z) / cdf
        return np.log(cdf), ratio, ratio * (ratio + z)

    def probability(self) -> Column:
        @F.pandas_udf("double")
        def phi(z):
            import pandas as pd

            return pd.Series(normal_cdf(z.to_numpy()))

        return phi(linear(self.coefficients))
