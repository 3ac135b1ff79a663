import pytest
from pyspark.sql import functions as F

from tabulon.functions.columns import FrozenDict, col
from tabulon.functions.weighted import assign_quantile, create_pond_data, grouped_weighted_quantiles, weighted_quantile, weighted_std
from tabulon.operators.groupstats import StatDesGroupBy, parse_spec
from tabulon.operators.tables import suppress_small


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [("a", "x", 1.0, 1.0), ("a", "y", 2.0, 2.0), ("b", "x", None, 3.0), ("b", "x", 4.0, 4.0), (None, "y", 5.0, 1.0), ("Total", "x", float("nan"), 2.0)], "g string, h string, v double, w double"
    )


def brute(small, keys, f):
    data = [r.asDict() for r in small.collect()]
    for r in data:
        if r["v"] is not None and r["v"] != r["v"]:
            r["v"] = None
    out = {}
    for r in data:
        from itertools import product

        for flags in product((True, False), repeat=len(keys)):
            out.setdefault((flags, tuple(r[k] if s else "*" for k, s in zip(keys, flags, strict=True))), []).append(r)
    return sorted((f(x) for x in out.values()), key=repr)


def test_cube_against_brute_force(small):
    got = StatDesGroupBy(small, ["g", "h"], ["v", "w"], var_weights="w").iterate_with_total(["sum", "mean", "count", "nunique"])

    def f(rs):
        some = [r for r in rs if r["v"] is not None]
        w = sum(r["w"] for r in rs)
        s = sum(r["v"] * r["w"] for r in some)
        return (s, w, s / w, sum(r["w"] ** 2 for r in rs) / w, len(some), len(rs), len({r["v"] for r in some}), len({r["w"] for r in rs}))

    assert sorted((r[2:] for r in rows(got)), key=repr) == brute(small, ["g", "h"], f)


def test_null_key_and_genuine_total_stay_apart(small):
    got = rows(StatDesGroupBy(small, ["g"], ["w"], total_label="All").iterate_with_total(["sum"]))
    assert got == [("Total", 2.0), ("a", 3.0), ("b", 7.0), (None, 1.0), ("All", 13.0)]


def test_levels_partition_the_cube(small):
    s = StatDesGroupBy(small, ["g", "h"], ["v"])
    whole = rows(s.iterate_with_total(["count"]))
    parts = rows(s.iterate_without_total(["count"])) + rows(s.add_under_total(["count"])) + rows(s.add_total(["count"]))
    assert sorted(whole, key=repr) == sorted(parts, key=repr)
    assert rows(StatDesGroupBy(small, [], ["v"]).iterate_with_total(["count"])) == [(4,)]
    assert rows(StatDesGroupBy(small, ["g"], ["v"]).add_under_total(["count"])) == []


def test_all_null_group(spark):
    df = spark.createDataFrame([("a", None, None)], "g string, v double, b boolean")
    got = rows(StatDesGroupBy(df, ["g"], ["v"]).iterate_without_total(["sum", "mean", "count", "majority", "median"]))
    assert got == [("a", 0.0, None, 0, None, None)]
    assert rows(StatDesGroupBy(df, ["g"], ["b"]).iterate_without_total(["any", "all"])) == [("a", False, True)]


def test_docstring_fixtures(spark):
    any_ = spark.createDataFrame([("a", True), ("b", False), ("a", True), ("c", False)], "A string, B boolean")
    assert rows(StatDesGroupBy(any_, ["A"], ["B"]).any()) == [("a", True), ("b", False), ("c", False)]
    count = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "A string, B int")
    assert rows(StatDesGroupBy(count, ["A"], ["B"]).count()) == [("a", 2), ("b", 1), (None, 1)]
    assert rows(StatDesGroupBy(count, ["A"], ["B"], dropna=True).nunique(["B"])) == [("a", 2), ("b", 1)]


def test_spec_rules():
    assert [o.columns for o in parse_spec({"sum": ["z", "a", "q"]}, ["z", "a"])] == [("a", "z")]
    assert [o.columns for o in parse_spec(["sum"], ["z", "a"])] == [("z", "a")]
    assert parse_spec({("quantile", FrozenDict(q=0.2)): "a"}, ["a"])[0]["q"] == 0.2
    for bad in ("sum", ["nothing"], [("quantile", {})]):
        with pytest.raises(ValueError):
            parse_spec(bad, ["a"])


def test_missing_column(small):
    with pytest.raises(KeyError):
        StatDesGroupBy(small, ["nope"], ["v"])


def test_key_that_is_also_a_value(small):
    got = rows(StatDesGroupBy(small, ["g"], ["g"]).iterate_with_total(["nunique", "count"]))
    assert got[-1] == ("Total", 3, 5)


def test_majority_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("a", "y", 1.0), ("a", "x", 1.0), ("a", "z", 0.5)], "g string, v string, w double")
    assert rows(StatDesGroupBy(df, ["g"], ["v"]).iterate_without_total(["majority"])) == [("a", "x")]
    assert rows(StatDesGroupBy(df, ["g"], ["v"], var_weights="w").iterate_with_total(["majority"])) == [("a", "x"), ("Total", "x")]


def plain_quantile(pairs, q):
    pairs = sorted(pairs)
    total, run, out = sum(w for _, w in pairs), 0.0, pairs[0][0]
    for v, w in pairs:
        run += w
        if run <= q * total:
            out = v
    return out


def test_weighted_quantile_against_the_definition(spark):
    import random

    rng = random.Random(3)
    data = [(rng.choice("ab"), float(rng.randint(0, 40)), float(rng.randint(0, 5))) for _ in range(500)] + [("c", 7.0, 2.0)]
    df = spark.createDataFrame(data, "g string, v double, w double")
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r[0]: tuple(r[1:]) for r in rows(grouped_weighted_quantiles(df, ["g"], "v", "w", qs))}
    for g in "abc":
        pairs = [(v, w) for k, v, w in data if k == g]
        assert got[g] == tuple(plain_quantile(pairs, q) for q in qs)


def test_unit_weights_and_lists(spark):
    df = spark.createDataFrame([(float(k), 1.0) for k in range(1, 11)], "v double, w double")
    assert rows(weighted_quantile(df, ["v"], None, 0.25)) == [("v", 3.25)]
    assert rows(weighted_quantile(df, ["v"], "w", [0.25, 0.5])) == [("v", 2.0, 5.0)]


def test_weighted_std(spark):
    df = spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 5.0, 3.0)], "a double, b double, w double")
    a = rows(weighted_std(df, ["a", "b"], "w"))[0]
    assert a == pytest.approx((0.4330127, 0.8660254))
    assert rows(weighted_std(df, ["a", "b"], None, axis=1).select("std")) == [(1.0,), (1.5,)]
    assert rows(weighted_std(df, ["a", "b"], None, axis=None))[0][0] == pytest.approx(1.47901995)
    with pytest.raises(Exception, match="missing"):
        weighted_std(df.withColumn("a", F.lit(None).cast("double")), ["a"]).collect()


def test_assign_quantile(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "v int")
    assert [r[1] for r in rows(assign_quantile(df, "v", [8, 5]))] == [0, 1, 2, None]
    assert [r[1] for r in rows(assign_quantile(df, "v", [8.5, 5], is_threshold=True))] == [1.0, 5.0, 8.5, None]


def test_pond_data(spark):
    df = spark.createDataFrame([(1, 4, 0.5), (2, 5, 1.0), (3, 6, 1.5)], "A int, B int, weights double")
    assert rows(create_pond_data(df, ["A"], None, "weights")) == [(0.5,), (2.0,), (4.5,)]


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0,)], "`a.b` double")
    out = StatDesGroupBy(df, [], ["a.b"]).add_total(["median"])
    assert out.columns == ["a.b_q0.5"] and out.select(col("a.b_q0.5")).first()[0] == 1.0


def odd_values(rng, n, weight):
    """Narrow clusters far from zero, both signs, the ends of doubles, ties."""
    pick = [lambda: 1e9 + rng.random() * 1e-3, lambda: -rng.expovariate(1e-3), lambda: float(rng.randint(0, 3)), lambda: 2.0 ** rng.randint(-1074, 1023), lambda: rng.choice([float("inf"), -float("inf"), 1.7976931348623157e308, -5e-324])]
    return [(rng.choice(["a", "b", None]), rng.choice("xy"), rng.choice(pick)(), weight(rng)) for _ in range(n)]


def by_sets(data):
    out = {}
    for g, h, v, w in data:
        for key in ((g, h), (g, "Total"), ("Total", h), ("Total", "Total")):
            out.setdefault(key, []).append((v, w))
    return out


@pytest.mark.parametrize(("sorted_rows", "steps"), [(1_000_000, 1024), (5, 4), (0, 1)])
def test_weighted_quantiles_sort_one_bucket_only(spark, monkeypatch, sorted_rows, steps):
    import random

    from tabulon.functions import weighted

    def not_all(*_):
        raise AssertionError("all values of a group are being sorted")

    monkeypatch.setattr(weighted, "running_sum_before", not_all)
    monkeypatch.setattr(weighted, "SORTED_ROWS", sorted_rows, raising=False)
    monkeypatch.setattr(weighted, "STEPS", steps, raising=False)
    data = odd_values(random.Random(5), 600, lambda r: float(r.choice([0, 1, 2, 300])))
    df = spark.createDataFrame(data, "g string, h string, v double, w double")
    qs = [0.0, 0.3, 0.5, 0.9, 1.0]
    got = {r[:2]: r[2:] for r in rows(StatDesGroupBy(df, ["g", "h"], ["v"], var_weights="w").iterate_with_total([("quantile", {"q": q}) for q in qs]))}
    assert got == {k: tuple(plain_quantile(pairs, q) for q in qs) for k, pairs in by_sets(data).items()}


def test_negative_weights_are_added_up_over_all_values(spark):
    data = [("a", float(v), w) for v, w in enumerate([5.0, 1.0, -4.0, 3.0, -2.0, 1.0])] + [("b", 1.0, 1.0), ("b", 2.0, 1.0)]
    df = spark.createDataFrame(data, "g string, v double, w double")
    got = {r[0]: r[1] for r in rows(grouped_weighted_quantiles(df, ["g"], "v", "w", [0.5]))}
    assert got == {g: plain_quantile([(v, w) for k, v, w in data if k == g], 0.5) for g in "ab"}


@pytest.mark.parametrize(("bits", "words"), [(62, 4), (3, 4), (2, 1)])
def test_distinct_counts_of_all_sets(spark, monkeypatch, bits, words):
    """One word of masks, several, and more cells than masks hold."""
    import random

    from tabulon.functions import distinct

    monkeypatch.setattr(distinct, "BITS", bits)
    monkeypatch.setattr(distinct, "WORDS", words)
    rng = random.Random(7)
    data = [(rng.choice(["a", "b", None]), rng.choice("xyz"), rng.choice([None, *range(60)]), float(rng.choice([0, 1, 2, "nan"]))) for _ in range(400)] + [("c", "x", None, float("nan"))]
    df = spark.createDataFrame(data, "g string, h string, i int, v double")
    ops = ["count_effectif", "nunique", ("inf_threshold", {"var_threshold": "v", "threshold": 1})]
    got = {r[:2]: r[2:] for r in rows(StatDesGroupBy(df, ["g", "h"], ["v"], var_individu="i").iterate_with_total(ops))}

    def f(rs):
        v = [x for _, x in rs if x == x]
        return len({i for i, _ in rs if i is not None}), len(set(v)), len({x for x in v if x < 1}) / len(set(v)) if v else None

    assert got == {k: f(rs) for k, rs in by_sets(data).items()}
    assert rows(StatDesGroupBy(df, ["g"], ["v"], var_individu="i").add_under_total(["count_effectif"])) == []
    assert rows(StatDesGroupBy(df.limit(0), [], ["v"], var_individu="i").iterate_with_total(["count_effectif"])) == [(0,)]


def test_distinct_counts_do_not_copy_rows_per_set(spark):
    """A count of distinct individuals and enterprises shuffles each pair of row and value once, not once per grouping set."""
    df = spark.range(2000).selectExpr("id % 3 AS g", "id % 2 AS h", "id AS i", "id % 50 AS e")
    out = StatDesGroupBy(df, ["g", "h"], [], var_individu="i", var_entreprise="e").iterate_with_total(["count_effectif"])
    assert [r[2:] for r in rows(out)][-1] == (2000, 50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan


def test_sums_beside_distinct_counts_copy_no_individuals(spark):
    df = spark.range(2000).selectExpr("id % 3 AS g", "id % 2 AS h", "id AS individual", "1.5D AS v")
    out = StatDesGroupBy(df, ["g", "h"], ["v"], var_individu="individual").iterate_with_total(["sum", "count_effectif"])
    hidden = suppress_small(out, counts=["individual_nunique"], n_min=334, values=["v_sum"])
    assert rows(hidden)[0] == ("0", "0", 501.0, 334, False) and rows(hidden)[1] == ("0", "1", None, 333, True)
    copies = [x for x in hidden._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Expand" in x]
    assert copies and not any("individual" in x for x in copies)


def test_medians_sort_one_bucket_only(spark, monkeypatch):
    import random
    from math import ceil, floor

    from tabulon.functions import weighted

    def not_all(*_):
        raise AssertionError("all values of a group are being sorted")

    monkeypatch.setattr(weighted, "running_sum_before", not_all)
    monkeypatch.setattr(weighted, "SORTED_ROWS", 3, raising=False)
    rng = random.Random(11)
    data = [(rng.choice(["a", "b", None]), rng.choice("xy"), rng.choice([None, 1e9 + rng.random(), -float(rng.randint(0, 4)), rng.random()]), 1.0) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, h string, v double, w double")
    got = {r[:2]: r[2:] for r in rows(StatDesGroupBy(df, ["g", "h"], ["v"]).iterate_with_total(["median", ("quantile", {"q": 0.3})]))}

    def linear(pairs, q):
        vs = sorted(v for v, _ in pairs if v is not None)
        p = q * (len(vs) - 1)
        low, high = vs[floor(p)], vs[ceil(p)]
        return low if low == high else (ceil(p) - p) * low + (p - floor(p)) * high

    assert got == {k: (linear(x, 0.5), linear(x, 0.3)) for k, x in by_sets(data).items()}
