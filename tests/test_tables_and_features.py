import pytest
from pyspark.sql import functions as F

from tabulon.functions.columns import FrozenDict, col, split_dummy, with_suffix
from tabulon.operators.excluders import ColumnExcluder, ForestOutliersIsolation, QuantileExcluder, ThresholdExcluder
from tabulon.operators.tables import apply_stars, convert_pvalues_to_stars, count_effectif_modalite, divide_by_total, nest_groupby, sort_with_total, star_text, suppress_small
from tabulon.operators.transformers import AddConstante, AddFixedEffect, AddInteraction, ClusteringTransformer, LogTransformer, OneHotEncoder, StandardScalerTransformer


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_names():
    assert split_dummy("Color - Blue - x") == ("Color", "Blue - x")
    assert with_suffix(["apple", "banana"], "_fruit") == {"apple": "apple_fruit", "banana": "banana_fruit"}
    assert star_text("0.25", 0.02) == "0.25 (**)"
    assert hash(FrozenDict(a=1)) == hash(FrozenDict(a=1)) and FrozenDict(a=1) == {"a": 1}


def test_stars(spark):
    df = spark.createDataFrame([(0.25, 0.02), (0.1, 0.5), (12345678.9, None), (None, 0.001)], "coef double, p_value double")
    got = [r[0] for r in rows(convert_pvalues_to_stars(df, "coef", "p_value", True).select(col("coef - p_value")))]
    assert got == ["25,0% (**)", "10,0% ()", "1234567890,0% ()", "nan% (***)"]
    assert [r[0] for r in rows(convert_pvalues_to_stars(df.limit(2), "coef", "p_value").select(col("coef - p_value")))] == ["0,25 (**)", "0,1 ()"]
    assert df.limit(1).select(apply_stars(F.col("coef"), F.col("p_value"))).first()[0] == "0.25 (**)"


def test_divide_by_total(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "Total", 4.0), ("b", "x", 2.0), ("b", "Total", 0.0)], "g string, h string, v double")
    assert sorted(rows(divide_by_total(df, ["g"], ["h"], ["v"])), key=repr) == sorted([("a", "x", 0.25), ("a", "Total", 1.0), ("b", "x", None), ("b", "Total", None)], key=repr)
    assert rows(divide_by_total(df.limit(2), ["g"], ["h"], ["v"], {"h": "x"})) == [("a", "x", 1.0), ("a", "Total", 4.0)]


def test_nesting(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "Total", 1), ("b", "x", 2), ("b", "y", 3), ("b", "Total", 5)], "g string, h string, v int")
    assert sorted(rows(nest_groupby(df, ["g", "h"]))) == [("a", "Total", 1), ("b", "Total", 5), ("b", "x", 2), ("b", "y", 3)]
    one = spark.createDataFrame([("x", 1), ("Total", 2)], "g string, v int")
    assert rows(nest_groupby(one, ["g"])) == [("Total", 2)]
    assert [r[:2] for r in rows(sort_with_total(df, ["g", "h"]))] == [("a", "x"), ("a", "Total"), ("b", "x"), ("b", "y"), ("b", "Total")]


def test_effectif_and_suppression(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "x")], "i int, g string, h string")
    assert rows(count_effectif_modalite([("g", "a"), ("h", "x")], df, "i")) == [("g", "a", 1), ("h", "x", 2), ("Intersection", "Intersection", 1)]
    out = rows(suppress_small(spark.createDataFrame([(1, 5.0), (9, 6.0)], "n int, v double"), ["n"], 3, values=["v"]))
    assert out == [(1, None, True), (9, 6.0, False)]
    with pytest.raises(ValueError):
        suppress_small(df, counts=["i"])


def test_threshold(spark):
    df = spark.createDataFrame([(1, 5), (6, 10), (3, 20), (7, 8), (None, 1)], "A int, B int")
    criteria = [{"variable": "A", "operator": ">", "threshold": 5}, {"variable": "B", "operator": "<=", "threshold": 10}]
    assert rows(ThresholdExcluder(criteria).transform(df)) == [(6, 10), (7, 8)]
    assert rows(ThresholdExcluder(criteria, drop=False).transform(df)) == [(1, None), (None, None), (3, 20), (None, None), (None, None)]
    assert len(rows(ThresholdExcluder([{"variable": "A", "operator": "!=", "threshold": 1}]).transform(df))) == 4


def test_quantile_excluder(spark):
    df = spark.createDataFrame([(k, 4 + k) for k in range(1, 5)], "A int, B int")
    c = [{"variable": "A", "side": "left", "threshold": 0.25}, {"variable": "B", "side": "right", "threshold": 0.1}]
    assert rows(QuantileExcluder(c).transform(df)) == [(2, 6), (3, 7)]
    assert rows(QuantileExcluder(c, drop=False).transform(df)) == [(None, 5), (2, 6), (3, 7), (4, None)]


def test_columns_and_forest(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (100, 100)], "A int, B int")
    assert ColumnExcluder(["B"]).transform(df).columns == ["A"]
    with pytest.raises(KeyError):
        ColumnExcluder(["C"]).transform(df)
    assert (100, 100) not in rows(ForestOutliersIsolation().fit_transform(df))
    assert ForestOutliersIsolation().fit_transform(df.limit(0)).count() == 0


def test_isolation_forest_on_a_sample_with_equal_rows(spark):
    """More rows than the trees take, a third of them equal: that block neither fills the sample nor is it taken for outliers."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 5D ELSE (id * 7919 % 1000) / 100D END AS x", "CASE WHEN id % 3 = 0 THEN 5D ELSE (id * 104729 % 997) / 100D END AS y")
    df = df.union(spark.createDataFrame([(100.0, 100.0)], "x double, y double"))
    left = ForestOutliersIsolation(n_estimators=20, max_samples=64).fit_transform(df)
    assert left.filter("x = 100").count() == 0 and left.filter("x = 5 and y = 5").count() >= 2000


def test_one_hot_round_trip(spark):
    df = spark.createDataFrame([("red", 10), ("green", 20), ("blue", 30), (None, 1)], "color string, value int")
    enc = OneHotEncoder(["color"])
    out = enc.fit_transform(df)
    assert out.columns == ["value", "color - blue", "color - green", "color - red"]
    assert rows(out)[0] == (10, False, False, True)
    assert rows(enc.inverse_transform(out))[:3] == [(10, "red"), (20, "green"), (30, "blue")]
    assert rows(enc.transform(spark.createDataFrame([("pink", 1)], "color string, value int"))) == [(1, False, False, False)]
    with pytest.raises(ValueError):
        OneHotEncoder(["color"], dtype=str)


def test_scaler_log_constant(spark):
    df = spark.createDataFrame([(float(k), 10.0 * k, 3.0) for k in range(1, 6)], "A double, B double, C double")
    s = StandardScalerTransformer()
    out = s.fit_transform(df)
    assert rows(out)[0] == pytest.approx((-1.41421356, -1.41421356, 0.0))
    assert [pytest.approx(x) for x in rows(s.inverse_transform(out))] == rows(df)
    logs = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double")
    assert [r[0] for r in rows(LogTransformer(["x"]).transform(logs))] == [0.0, None, 0.0]
    assert rows(LogTransformer(["x"], False).transform(logs))[0][0] == float("-inf")
    assert AddConstante().fit_transform(df).columns[-1] == "Constante"


def test_effects(spark):
    df = spark.createDataFrame([("Red", "Circle", 1), ("Green", "Square", 2)], "Color string, Shape string, Value int")
    more = df.union(spark.createDataFrame([("Blue", "Circle", 3)], df.schema))
    assert AddFixedEffect("Color", "Red").fit_transform(more).select("Green", "Blue").collect() == [(0, 0), (1, 0), (0, 1)]
    out = AddInteraction(["Color", "Shape"], ["Red"]).fit_transform(df)
    assert out.columns[3:] == ["Green - Circle", "Green - Square"] and [r[3:] for r in rows(out)] == [(0, 0), (0, 1)]


def test_clusters(spark):
    df = spark.createDataFrame([(float(k % 3) * 100 + k / 10, 1.0) for k in range(30)], "x double, y double")
    from pyspark.ml.clustering import KMeans

    out = ClusteringTransformer(KMeans(k=3, seed=1)).fit_transform(df)
    assert out.columns[0] == "labels" and {(r[0], round(r[1] / 100)) for r in rows(out)} == {(0, 0), (1, 1), (2, 2)}


def test_modalities_do_not_copy_rows_per_condition(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("a", "x", None), ("a", None, 2)], "g string, h string, i int")
    out = count_effectif_modalite([("g", "a"), ("h", "x")], df, "i")
    assert rows(out) == [("g", "a", 2), ("h", "x", 1), ("Intersection", "Intersection", 1)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
