import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.columns import col
from tabulon.functions.distributions import normal_cdf, t_quantile, t_two_sided
from tabulon.operators.classifiers import LogitClassifier, ProbitClassifier
from tabulon.operators.regressors import LeastSquaresEstimator, OaxacaBlinder, PanelLeastSquaresEstimator
from tabulon.operators.transformers import AddConstante
from tabulon.plans.inference import estimate_summarize
from tabulon.plans.prediction import crossval_predict


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x, z, w = rng.normal(1e6, 3, 400), rng.normal(size=400), rng.integers(0, 4, 400).astype(float)
    y = 3 * (x - 1e6) - 2 * z + 7 + rng.normal(size=400)
    c = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + z)))).astype(int)
    df = spark.createDataFrame([(k, float(a), float(b), float(d), float(e), int(f), k % 20, k // 20 % 9) for k, (a, b, d, e, f) in enumerate(zip(x, z, w, y, c, strict=True))], "id long, x double, z double, w double, y double, c int, ent int, tim int").withColumn("one", F.lit(1))
    return df.cache(), x, z, w, y, c


def table(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_distributions():
    assert t_quantile(0.975, 30) == pytest.approx(2.042272456, abs=1e-8)
    assert t_two_sided(2.042272456, 30) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided(0, 5) == pytest.approx(1) and t_quantile(0.5, 3) == 0
    assert t_two_sided(3.0, 1) == pytest.approx(1 - 2 * math.atan(3) / math.pi)
    assert normal_cdf(np.array([0.0, 1.959963985]))[1] == pytest.approx(0.975)


@pytest.mark.parametrize("weight", [None, "w"])
def test_least_squares(data, weight):
    df, x, z, w, y, _ = data
    a = np.c_[np.ones(400), x, z]
    s = np.sqrt(w) if weight else np.ones(400)
    b = np.linalg.lstsq((a - [0, 1e6, 0]) * s[:, None], y * s, rcond=None)[0]
    rows = df.filter("w > 0") if weight else df
    e = LeastSquaresEstimator().fit(rows, ["one", "x", "z"], "y", weight)
    assert [e.coefficients["x"], e.coefficients["z"]] == pytest.approx(list(b[1:]))
    r = (y - (a - [0, 1e6, 0]) @ b) * s
    n = int((w > 0).sum()) if weight else 400
    scale = (r @ r) / (n - 3)
    se = np.sqrt(np.diag(np.linalg.inv(((a - [0, 1e6, 0]) * s[:, None]).T @ ((a - [0, 1e6, 0]) * s[:, None]))) * scale)
    got = table(e.summary())["z"]
    assert got[2] == pytest.approx(b[2] - t_quantile(0.975, n - 3) * se[2]) and got[3] > got[0] > got[2] and got[1] < 1e-9
    m = (s * s * y).sum() / (s * s).sum()
    assert e.rsquared().first()[0] == pytest.approx(1 - (r @ r) / (s * s * (y - m) ** 2).sum())
    assert e.predict(rows).select(F.corr("prediction", "y")).first()[0] > 0.98


def test_without_constant_and_collinear(data):
    df, _, z, _, y, _ = data
    e = LeastSquaresEstimator().fit(df, ["z"], "y")
    assert not e.centred and e.coefficients["z"] == pytest.approx((z @ y) / (z @ z))
    two = LeastSquaresEstimator().fit(df.withColumn("z2", 2 * F.col("z")), ["one", "z", "z2"], "y")
    assert two.rank == 2


def test_many_columns_take_partial_sums(data):
    df = data[0]
    wide = df.select("y", "one", *(F.rand(k).alias(f"f{k}") for k in range(36)))
    e = LeastSquaresEstimator().fit(wide, ["one", *(f"f{k}" for k in range(36))], "y")
    assert e.rank == 37


def test_panel_equals_dummies(data):
    df, x, z, _, y, _ = data
    ent, tim = np.arange(400) % 20, np.arange(400) // 20 % 9
    d = np.c_[z, x - 1e6, np.eye(20)[ent], np.eye(9)[tim][:, 1:]]
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    shifted = df.withColumn("x", F.col("x") - 1e6)
    p = PanelLeastSquaresEstimator(True, True).fit(shifted, ["z", "x"], "y", "ent", "tim")
    assert list(p.coefficients.values()) == pytest.approx(list(b[:2]))
    r = y - d @ b
    assert p.ssr == pytest.approx(r @ r) and p.df_resid == 400 - 2 - 28
    effects = p.estimated_effects().toPandas().set_index(["entity", "time"])["estimated_effects"]
    assert effects.loc[(3, 4)].iloc[0] == pytest.approx((d[:, 2:] @ b[2:])[(ent == 3) & (tim == 4)][0])
    out = p.rsquared().first()
    assert out["n_observations"] == 400 and out["R2 - Effets fixes inclus"] == pytest.approx(1 - (r @ r) / ((y - y.mean()) ** 2).sum())
    turn = PanelLeastSquaresEstimator(True, True)
    turn.entity, turn.time = "ent", "tim"
    inside = turn._in_turn(shifted.withColumn("_w", F.lit(1.0)).select("ent", "tim", "_w", "z", "y"), ["z", "y"]).toPandas()
    inside2 = turn._with_dummies(shifted.withColumn("_w", F.lit(1.0)).select("ent", "tim", "_w", "z", "y"), ["z", "y"], list(range(1, 9))).toPandas()
    assert sorted(inside.z) == pytest.approx(sorted(inside2.z), abs=1e-7)
    with pytest.raises(ValueError, match="absorbed"):
        PanelLeastSquaresEstimator(True).fit(df, ["one", "z"], "y", "ent", "tim")
    assert PanelLeastSquaresEstimator(True, drop_absorbed=True).fit(df, ["one", "z"], "y", "ent", "tim").features == ["z"]


def newton(a, c, link):
    b = np.zeros(a.shape[1])
    for _ in range(60):
        z = a @ b
        if link == "logit":
            p = 1 / (1 + np.exp(-z))
            g, h = c - p, p * (1 - p)
        else:
            q = 2 * c - 1
            g = q * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / normal_cdf(q * z)
            h = g * (g + z)
        b = b + np.linalg.solve((a * h[:, None]).T @ a, a.T @ g)
    return b, np.linalg.inv((a * h[:, None]).T @ a)


@pytest.mark.parametrize(("kind", "link"), [(LogitClassifier, "logit"), (ProbitClassifier, "probit")])
def test_classifiers(data, kind, link):
    df, _, z, _, _, c = data
    b, v = newton(np.c_[np.ones(400), z], c, link)
    e = kind().fit(df, ["one", "z"], "c")
    assert e.converged and list(e.coefficients.values()) == pytest.approx(list(b))
    assert e.covariance == pytest.approx(v, rel=1e-5)
    p = e.predict_proba(df).select("proba_0", "proba_1").toPandas()
    assert (p.sum(axis=1) - 1).abs().max() < 1e-12
    hit = e.predict(df).select(F.avg((F.col("prediction") == F.col("c")).cast("double"))).first()[0]
    assert kind(scoring="accuracy").set_params().get_params()["scoring"] == "accuracy"
    e.scoring = "accuracy"
    assert e.score(df) == pytest.approx(hit)
    e.scoring = "roc"
    y, s = c, p.proba_1.to_numpy()
    auc = np.mean([(a > d) + 0.5 * (a == d) for a in s[y == 1] for d in s[y == 0]])
    assert e.score(df, on="proba") == pytest.approx(auc)
    lasso = kind(regularized=True, alpha=1e4).fit(df, ["one", "z"], "c")
    assert list(lasso.coefficients.values()) == [0.0, 0.0]


def test_marginal_effects(data):
    df, _, z, _, _, c = data
    e = LogitClassifier().fit(df, ["one", "z"], "c")
    b = np.array(list(e.coefficients.values()))
    p = 1 / (1 + np.exp(-(b[0] + b[1] * z)))
    got = table(e.margeff())
    assert set(got) == {"z"} and got["z"][0] == pytest.approx((p * (1 - p)).mean() * b[1]) and got["z"][1] > 0


@pytest.mark.parametrize("method", ["pooled", "other"])
def test_oaxaca_adds_up(data, method):
    df = data[0].withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    o = OaxacaBlinder("g", method).fit(df, ["one", "z"], "y")
    d = {r[0]: r[1] for r in o.decompose().collect()}
    assert d["Explained Effect"] + d["Unexplained Effect"] == pytest.approx(d["Gap"])
    assert sum(r[1] for r in o.decompose(detailed=True).collect()) == pytest.approx(d["Explained Effect"])
    with pytest.raises(ValueError):
        OaxacaBlinder("g", "nothing")


def test_estimate_summarize(data):
    s, r = estimate_summarize(LeastSquaresEstimator(), data[0].select("z", "y", "w"), ["z"], "y", transformer=AddConstante(), sample_weight="w")
    assert set(table(s)) == {"z", "Constante"} and 0 < r.first()[0] < 1


def test_crossval(data):
    df, _, z, _, y, _ = data
    out = crossval_predict(LeastSquaresEstimator(), df, ["one", "z"], "y", "id", cv=4, compute_confidence_interval=True, n_iterations_boostrap=15, bootstrap_size=0.9, alpha=0.9).toPandas().sort_values("id")
    k = out.fold.to_numpy()
    a = np.c_[np.ones(400), z]
    for f in range(4):
        b = np.linalg.lstsq(a[k != f], y[k != f], rcond=None)[0]
        assert out.prediction.to_numpy()[k == f] == pytest.approx(a[k == f] @ b)
    assert (out.lower <= out.upper).all() and ((out.lower - 1 <= out.prediction) & (out.prediction <= out.upper + 1)).all()
    logit = crossval_predict(LogitClassifier(), df, ["one", "z"], "c", "id", cv=2)
    assert logit.count() == 400 and {r[0] for r in logit.select("prediction").distinct().collect()} <= {0.0, 1.0}


def test_dotted_target(data):
    df = data[0].select("one", col("z").alias("z.1"), col("y").alias("y/2"))
    assert LeastSquaresEstimator().fit(df, ["one", "z.1"], "y/2").rank == 2
