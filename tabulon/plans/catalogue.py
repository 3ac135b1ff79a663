"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import FrozenDict, col, split_dummy_column
from ..functions.lineage import shared_dir
from ..functions.weighted import assign_quantile, create_pond_data, weighted_quantile, weighted_std
from ..operators.classifiers import LogitClassifier, ProbitClassifier
from ..operators.excluders import ColumnExcluder, ForestOutliersIsolation, QuantileExcluder, ThresholdExcluder
from ..operators.groupstats import StatDesGroupBy
from ..operators.regressors import LeastSquaresEstimator, OaxacaBlinder, PanelLeastSquaresEstimator
from ..operators.tables import convert_pvalues_to_stars, count_effectif_modalite, divide_by_total, nest_groupby, sort_with_total, suppress_small
from ..operators.transformers import AddConstante, AddFixedEffect, AddInteraction, ClusteringTransformer, LogTransformer, OneHotEncoder, StandardScalerTransformer
from ..sources.store import load, save
from ..streaming.windows import windowed_statistics
from . import estimator_sql
from .inference import estimate_summarize
from .prediction import crossval_predict

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    """lineitem with a column that has nulls."""
    return t(spark, sf_dir, "lineitem").withColumn("disc", F.expr("nullif(l_discount, 0)"))


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(col(c), own.get(c, digits)).alias(c) if kinds[c] == "double" else col(c) for c in df.columns))


FLAGS = ["l_returnflag", "l_linestatus"]
LINES = "(SELECT *, nullif(l_discount, 0) AS disc, l_returnflag AS a, l_linestatus AS b FROM lineitem)"


def total(c: str, name: str) -> str:
    return f"CASE WHEN grouping({c}) = 1 THEN 'Total' ELSE {c}::VARCHAR END AS {name}"


LABELS = f"{total('a', 'l_returnflag')}, {total('b', 'l_linestatus')}"

# group statistics


@query(f"""SELECT {LABELS}, round(coalesce(sum(l_extendedprice * l_quantity), 0), 2) AS l_extendedprice_sum, round(coalesce(sum(disc * l_quantity), 0), 2) AS disc_sum,
  round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS l_extendedprice_mean, round(coalesce(sum(disc * l_quantity), 0) / sum(l_quantity), 6) AS disc_mean
  FROM {LINES} GROUP BY CUBE (a, b)""")
def cube_weighted_sum_mean(spark, sf_dir):
    out = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_extendedprice", "disc"], var_weights="l_quantity").iterate_with_total(["sum", "mean"])
    return rounded(out, l_extendedprice_sum=2, disc_sum=2)


BASE = "round(coalesce(sum(l_extendedprice), 0), 2) AS l_extendedprice_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_mean, count(l_extendedprice) AS l_extendedprice_count"
BASE_OPS = ["sum", "mean", "count"]


def _base(spark, sf_dir):
    return StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_extendedprice"])


@query(f"SELECT a AS l_returnflag, b AS l_linestatus, {BASE} FROM {LINES} GROUP BY a, b")
def groupby_no_total(spark, sf_dir):
    return rounded(_base(spark, sf_dir).iterate_without_total(BASE_OPS), l_extendedprice_sum=2)


@query(f"SELECT {LABELS}, {BASE} FROM {LINES} GROUP BY GROUPING SETS ((a), (b))")
def subtotals_only(spark, sf_dir):
    return rounded(_base(spark, sf_dir).add_under_total(BASE_OPS), l_extendedprice_sum=2)


@query(f"SELECT 'Total' AS l_returnflag, 'Total' AS l_linestatus, {BASE} FROM {LINES}")
def grand_total(spark, sf_dir):
    return rounded(_base(spark, sf_dir).add_total(BASE_OPS), l_extendedprice_sum=2)


def orders(spark, sf_dir):
    return t(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate"))


@query(f"""SELECT {total('a', 'o_orderstatus')}, {total('b', 'o_orderpriority')}, {total('c', 'o_year')}, round(sum(p), 2) AS o_totalprice_sum, count(p) AS o_totalprice_count, count(DISTINCT k) AS o_custkey_nunique
  FROM (SELECT o_orderstatus AS a, o_orderpriority AS b, year(o_orderdate) AS c, o_totalprice AS p, o_custkey AS k FROM orders) GROUP BY CUBE (a, b, c)""")
def cube_three_keys(spark, sf_dir):
    s = StatDesGroupBy(orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority", "o_year"], ["o_totalprice"], var_individu="o_custkey")
    return rounded(s.iterate_with_total(["sum", "count", "count_effectif"]), 2)


@query(f"SELECT {LABELS}, count(DISTINCT disc) AS disc_nunique, count(DISTINCT l_suppkey) AS l_suppkey_nunique, count(disc) AS disc_count, count(l_suppkey) AS l_suppkey_count FROM {LINES} GROUP BY CUBE (a, b)")
def cube_nunique_count(spark, sf_dir):
    return StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["disc", "l_suppkey"]).iterate_with_total(["nunique", "count"])


@query(f"SELECT {LABELS}, coalesce(bool_or(x), false) AS x_any, coalesce(bool_or(y <> 0), false) AS y_any, coalesce(bool_and(x), true) AS x_all, coalesce(bool_and(y <> 0), true) AS y_all FROM (SELECT *, CASE WHEN l_tax > 0 THEN l_quantity > 1 END AS x, CASE WHEN l_linestatus <> 'O' THEN l_linenumber - 1 END AS y FROM {LINES}) GROUP BY CUBE (a, b)")
def any_all(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("x", F.expr("CASE WHEN l_tax > 0 THEN l_quantity > 1 END")).withColumn("y", F.expr("CASE WHEN l_linestatus <> 'O' THEN l_linenumber - 1 END"))
    return StatDesGroupBy(df, FLAGS, ["x", "y"]).iterate_with_total(["any", "all"])


@query(f"SELECT {LABELS}, round(sum(disc * l_quantity) / sum(l_tax * l_quantity), 6) AS disc_l_tax_prop, round(sum(l_tax * l_quantity) / sum(l_tax * l_quantity), 6) AS l_tax_l_tax_prop FROM {LINES} GROUP BY CUBE (a, b)")
def prop(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["disc", "l_tax"], var_weights="l_quantity")
    return rounded(s.iterate_with_total([("prop", {"var_ref": "l_tax"})]))


@query(f"SELECT {LABELS}, round(count(DISTINCT l_suppkey) FILTER (WHERE l_quantity < 3) / count(DISTINCT l_suppkey), 6) AS l_suppkey_inf_3 FROM {LINES} GROUP BY CUBE (a, b)")
def inf_threshold(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_suppkey", "l_quantity"])
    return rounded(s.iterate_with_total({("inf_threshold", FrozenDict(var_threshold="l_quantity", threshold=3)): ["l_suppkey"]}))


@query(f"SELECT {LABELS}, count(DISTINCT l_orderkey) AS l_orderkey_nunique, count(DISTINCT l_suppkey) AS l_suppkey_nunique FROM {LINES} GROUP BY CUBE (a, b)")
def count_effectif(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_tax"], var_individu="l_orderkey", var_entreprise="l_suppkey")
    return s.iterate_with_total(["count_effectif"])


@query(f"""SELECT {LABELS}, round(max(l_extendedprice * l_quantity) / sum(l_extendedprice * l_quantity), 9) AS "l_extendedprice_l_orderkey_max/sum",
  round(max(l_extendedprice * l_quantity) / sum(l_extendedprice * l_quantity), 9) AS "l_extendedprice_l_suppkey_max/sum" FROM {LINES} GROUP BY CUBE (a, b)""")
def max_sum(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_extendedprice"], "l_orderkey", "l_suppkey", "l_quantity")
    return rounded(s.iterate_with_total(["max_sum_effectif"]), 9)


@query(f"SELECT {LABELS}, sum(l_quantity) AS l_quantity_sum, round(sum(l_tax * l_quantity), 2) AS l_tax_sum FROM {LINES} GROUP BY CUBE (a, b)")
def sum_of_weights(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_quantity", "l_tax"], var_weights="l_quantity")
    return rounded(s.iterate_with_total(["sum"]), 2)


@query(f"""SELECT {LABELS}, round(quantile_cont(l_extendedprice, 0.5), 6) AS "l_extendedprice_q0.5", round(quantile_cont(disc, 0.5), 6) AS "disc_q0.5" FROM {LINES} GROUP BY CUBE (a, b)""")
def median_unweighted(spark, sf_dir):
    return rounded(StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_extendedprice", "disc"]).iterate_with_total(["median"]))


@query(f"""SELECT a AS l_returnflag, b AS l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) AS "l_extendedprice_q0.1", round(quantile_cont(l_extendedprice, 0.9), 6) AS "l_extendedprice_q0.9" FROM {LINES} GROUP BY a, b""")
def quantile_q(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_extendedprice"])
    return rounded(s.iterate_without_total([("quantile", {"q": 0.1}), ("quantile", {"q": 0.9})]))


def weighted_sql(keys: str, v: str, qs: list[float], source: str, select: str) -> str:
    picks = ", ".join(f'coalesce(max(v) FILTER (WHERE c <= {q} * total), min(v)) AS "{v}_q{q}"' for q in qs)
    return f"""WITH s AS (SELECT {keys}, {v} AS v, l_quantity AS w FROM {source} WHERE {v} IS NOT NULL AND l_quantity IS NOT NULL),
  c AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY {keys}) AS total FROM s)
  SELECT {select}, {picks} FROM c GROUP BY {keys}"""


@query(weighted_sql("a, b", "disc", [0.25, 0.5], LINES, "a AS l_returnflag, b AS l_linestatus"))
def weighted_quantile_groups(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["disc"], var_weights="l_quantity")
    return s.iterate_without_total([("quantile", {"q": 0.25}), "median"])


_SETS = f"""(SELECT a, b, l_extendedprice, l_quantity FROM {LINES} UNION ALL SELECT a, 'Total', l_extendedprice, l_quantity FROM {LINES}
  UNION ALL SELECT 'Total', b, l_extendedprice, l_quantity FROM {LINES} UNION ALL SELECT 'Total', 'Total', l_extendedprice, l_quantity FROM {LINES})"""


@query(
    f"""SELECT q.*, m.l_extendedprice_sum FROM ({weighted_sql("a, b", "l_extendedprice", [0.5, 0.9], _SETS, "a AS l_returnflag, b AS l_linestatus")}) q
  JOIN (SELECT {LABELS}, round(sum(l_extendedprice * l_quantity), 2) AS l_extendedprice_sum FROM {LINES} GROUP BY CUBE (a, b)) m USING (l_returnflag, l_linestatus)"""
)
def weighted_quantile_cube(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_extendedprice"], var_weights="l_quantity")
    return rounded(s.iterate_with_total(["median", ("quantile", {"q": 0.9}), "sum"]), 2)


@query(f"""SELECT variable, coalesce(max(v) FILTER (WHERE c <= 0.25 * total), min(v)) AS "q0.25", coalesce(max(v) FILTER (WHERE c <= 0.75 * total), min(v)) AS "q0.75" FROM (
  SELECT variable, v, sum(w) OVER (PARTITION BY variable ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY variable) AS total FROM (
  SELECT 'l_extendedprice' AS variable, l_extendedprice AS v, l_quantity AS w FROM {LINES} UNION ALL SELECT 'disc', disc, l_quantity FROM {LINES} WHERE disc IS NOT NULL)) GROUP BY variable""")
def weighted_quantile_table(spark, sf_dir):
    return weighted_quantile(lines(spark, sf_dir), ["l_extendedprice", "disc"], "l_quantity", [0.25, 0.75])


_ORD = "(SELECT *, o_orderstatus AS a, o_orderpriority AS p, o_custkey % 7 AS c7 FROM orders)"


@query(f"SELECT {total('a', 'o_orderstatus')}, first(p ORDER BY n DESC, p) AS o_orderpriority_majority FROM (SELECT a, p, count(*) AS n FROM {_ORD} GROUP BY a, p UNION ALL SELECT 'Total', p, count(*) FROM {_ORD} GROUP BY p) GROUP BY a".replace(total("a", "o_orderstatus"), "a AS o_orderstatus"))
def majority(spark, sf_dir):
    return StatDesGroupBy(orders(spark, sf_dir), ["o_orderstatus"], ["o_orderpriority"]).iterate_with_total(["majority"])


@query(f"""SELECT a AS o_orderstatus, first(p ORDER BY n DESC, p) AS o_orderpriority_majority FROM (SELECT a, p, sum(c7) AS n FROM {_ORD} GROUP BY a, p UNION ALL SELECT 'Total', p, sum(c7) FROM {_ORD} GROUP BY p) GROUP BY a""")
def majority_weighted(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("c7", F.col("o_custkey") % 7)
    return StatDesGroupBy(df, ["o_orderstatus"], ["o_orderpriority"], var_weights="c7").iterate_with_total(["majority"])


# weighted kernels


@query("""WITH m AS (SELECT sum(l_extendedprice * l_quantity) / sum(l_quantity) AS p, sum(l_tax * l_quantity) / sum(l_quantity) AS x FROM lineitem)
  SELECT round(sqrt(sum(l_quantity * (l_extendedprice - p) ** 2) / sum(l_quantity)), 6) AS l_extendedprice, round(sqrt(sum(l_quantity * (l_tax - x) ** 2) / sum(l_quantity)), 6) AS l_tax FROM lineitem, m""")
def weighted_std_columns(spark, sf_dir):
    return rounded(weighted_std(t(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"], "l_quantity"))


@query("SELECT c_custkey, (c_acctbal >= 0)::INT + (c_acctbal >= 2500.5)::INT + (c_acctbal >= 7000)::INT AS c_acctbal_quantile FROM customer")
def assign_quantile_label(spark, sf_dir):
    return assign_quantile(t(spark, sf_dir, "customer"), "c_acctbal", [7000, 0, 2500.5]).select("c_custkey", "c_acctbal_quantile")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 7000 THEN 7000 WHEN c_acctbal >= 2500.5 THEN 2500.5 ELSE (SELECT min(c_acctbal) FROM customer) END::DOUBLE AS c_acctbal_quantile FROM customer")
def assign_quantile_threshold(spark, sf_dir):
    return assign_quantile(t(spark, sf_dir, "customer"), "c_acctbal", [7000, 2500.5], is_threshold=True).select("c_custkey", "c_acctbal_quantile")


@query("SELECT l_returnflag, round(l_extendedprice * l_quantity, 2) AS l_extendedprice, round(l_tax * l_quantity, 4) AS l_tax FROM lineitem")
def pond_data(spark, sf_dir):
    return rounded(create_pond_data(t(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"], ["l_returnflag"], "l_quantity"), l_extendedprice=2, l_tax=4)


# tables of results

_CUBE = f"(SELECT {LABELS}, sum(l_extendedprice) AS s, count(*) AS n FROM {LINES} GROUP BY CUBE (a, b))"


@query(f"SELECT x.l_returnflag, x.l_linestatus, round(x.s / r.s, 9) AS l_extendedprice_sum, round(x.n / r.n, 9) AS l_extendedprice_count FROM {_CUBE} x JOIN {_CUBE} r ON x.l_returnflag = r.l_returnflag AND r.l_linestatus = 'Total'")
def divide_by_total_rows(spark, sf_dir):
    stats = _base(spark, sf_dir).iterate_with_total(["sum", "count"])
    return rounded(divide_by_total(stats, ["l_returnflag"], ["l_linestatus"], ["l_extendedprice_sum", "l_extendedprice_count"]), 9)


@query(f"""WITH x AS {_CUBE}, k AS (SELECT l_returnflag, count(DISTINCT l_linestatus) = 2 AND bool_or(l_linestatus = 'Total') AS fold FROM x GROUP BY 1),
  y AS (SELECT x.l_returnflag, CASE WHEN fold THEN 'Total' ELSE l_linestatus END AS l_linestatus, l_linestatus = 'Total' AS own, s, n FROM x JOIN k USING (l_returnflag))
  SELECT l_returnflag, l_linestatus, round(first(s ORDER BY own DESC), 2) AS l_extendedprice_sum, first(n ORDER BY own DESC) AS l_extendedprice_count FROM y GROUP BY l_returnflag, l_linestatus""")
def nest_groupby_rows(spark, sf_dir):
    return rounded(sort_with_total(nest_groupby(_base(spark, sf_dir).iterate_with_total(["sum", "count"]), FLAGS), FLAGS), 2)


@query("""SELECT 'o_orderstatus' AS variable, 'F' AS modalite_ref, count(DISTINCT o_custkey) AS nombre_individus FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'o_orderpriority', '1-URGENT', count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'Intersection', 'Intersection', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def effectif_modalite(spark, sf_dir):
    return count_effectif_modalite([("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")], t(spark, sf_dir, "orders"), "o_custkey")


_STARS = "CASE WHEN p < 0.01 THEN ' (***)' WHEN p < 0.05 THEN ' (**)' WHEN p < 0.1 THEN ' (*)' ELSE ' ()' END"


@query(f"""SELECT p_partkey, replace(CASE WHEN c = trunc(c) THEN format('{{:.1f}}', c) ELSE rtrim(format('{{:.2f}}', c), '0') END, '.', ',') || {_STARS} AS "coef - p"
  FROM (SELECT p_partkey, p_size / 4.0 AS c, p_partkey % 20 / 100.0 AS p FROM part)""")
def stars(spark, sf_dir):
    df = t(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 4.0D AS coef", "p_partkey % 20 / 100.0D AS p")
    return convert_pvalues_to_stars(df, "coef", "p").select("p_partkey", col("coef - p"))


@query("""SELECT p_partkey, CASE WHEN instr(d, ' - ') > 0 THEN left(d, instr(d, ' - ') - 1) ELSE d END AS category, CASE WHEN instr(d, ' - ') > 0 THEN substr(d, instr(d, ' - ') + 3) ELSE '' END AS modality
  FROM (SELECT p_partkey, p_brand || ' - ' || p_type || ' - x' AS d FROM part)""")
def split_dummies(spark, sf_dir):
    df = t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" - ", "p_brand", "p_type", F.lit("x")).alias("d"))
    category, modality = split_dummy_column(F.col("d"))
    return df.select("p_partkey", category.alias("category"), modality.alias("modality"))


@query(f"""SELECT l_returnflag, l_linestatus, CASE WHEN NOT h THEN s END AS l_tax_sum, n AS l_orderkey_nunique, h AS secret FROM (
  SELECT {LABELS}, round(sum(l_tax), 2) AS s, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) < 3000 AS h FROM {LINES} GROUP BY CUBE (a, b))""")
def suppress_small_groups(spark, sf_dir):
    s = StatDesGroupBy(lines(spark, sf_dir), FLAGS, ["l_tax"], var_individu="l_orderkey").iterate_with_total(["sum", "count_effectif"])
    return rounded(suppress_small(s, counts=["l_orderkey_nunique"], n_min=3000, values=["l_tax_sum"]), 2)


# excluders


@query("SELECT * FROM customer WHERE c_acctbal > 1000 AND c_nationkey <= 10 AND c_mktsegment <> 'BUILDING'")
def threshold_drop(spark, sf_dir):
    criteria = [("c_acctbal", ">", 1000), ("c_nationkey", "<=", 10), ("c_mktsegment", "!=", "BUILDING")]
    return ThresholdExcluder([dict(zip(("variable", "operator", "threshold"), c, strict=True)) for c in criteria]).transform(t(spark, sf_dir, "customer"))


@query("SELECT c_custkey, c_name, CASE WHEN NOT (c_nationkey = 3) THEN c_nationkey END AS c_nationkey, CASE WHEN NOT (c_acctbal > 5000 OR c_acctbal < 0) THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def threshold_null(spark, sf_dir):
    criteria = [("c_acctbal", ">", 5000), ("c_acctbal", "<", 0), ("c_nationkey", "==", 3)]
    return ThresholdExcluder([dict(zip(("variable", "operator", "threshold"), c, strict=True)) for c in criteria], drop=False).transform(t(spark, sf_dir, "customer"))


_QC = [{"variable": "p_retailprice", "side": "both", "threshold": 0.1}, {"variable": "p_size", "side": "left", "threshold": 0.25}]
_QS = "(SELECT quantile_cont(p_retailprice, 0.1) AS a, quantile_cont(p_retailprice, 0.9) AS b, quantile_cont(p_size, 0.25) AS c FROM part)"


@query(f"SELECT part.* FROM part, {_QS} WHERE p_retailprice > a AND p_retailprice < b AND p_size > c")
def quantile_drop(spark, sf_dir):
    return QuantileExcluder(_QC).transform(t(spark, sf_dir, "part"))


@query(f"SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN NOT (p_size < c) THEN p_size END AS p_size, CASE WHEN NOT (p_retailprice < a OR p_retailprice > b) THEN p_retailprice END AS p_retailprice FROM part, {_QS}")
def quantile_null(spark, sf_dir):
    return QuantileExcluder(_QC, drop=False).transform(t(spark, sf_dir, "part"))


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part")
def column_excluder(spark, sf_dir):
    return ColumnExcluder(["p_name", "p_retailprice"]).fit_transform(t(spark, sf_dir, "part"))


@query()
def isolation_forest(spark, sf_dir):
    """Rows that stay; which ones depends on the random trees, which a seed fixes."""
    df = t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return ForestOutliersIsolation(columns=["p_size", "p_retailprice"]).fit_transform(df)


# files

_PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _through(spark, sf_dir, ext: str) -> DataFrame:
    """part, written as ext to the shared folder and read again, in its own types."""
    part = t(spark, sf_dir, "part")
    path = f"{shared_dir(spark)}/part-{uuid.uuid4().hex}.{ext}"
    save(part, path)
    return load(spark, path).select(*(F.col(n).cast(kind).alias(n) for n, kind in part.dtypes))


@query(_PART)
def save_load_csv(spark, sf_dir):
    return _through(spark, sf_dir, "csv")


@query(_PART)
def save_load_json(spark, sf_dir):
    return _through(spark, sf_dir, "json")


@query(_PART)
def save_load_parquet(spark, sf_dir):
    return _through(spark, sf_dir, "parquet")


# transformers

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_STATUS = ["F", "O", "P"]


@query("SELECT c_custkey, " + ", ".join(f"""c_mktsegment = '{s}' AS "c_mktsegment - {s}" """ for s in _SEGMENTS) + " FROM customer")
def one_hot(spark, sf_dir):
    return OneHotEncoder(["c_mktsegment"]).fit_transform(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def one_hot_inverse(spark, sf_dir):
    enc = OneHotEncoder(["c_mktsegment"], dtype=int)
    return enc.inverse_transform(enc.fit_transform(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")))


@query("""SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)""")
def standard_scale(spark, sf_dir):
    return rounded(StandardScalerTransformer(["c_acctbal"]).fit_transform(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")))


@query("SELECT round(CASE WHEN l_discount = 0 THEN 0 WHEN l_discount > 0 THEN ln(l_discount) END, 6) AS l_discount, round(ln(l_quantity), 6) AS l_quantity, l_orderkey, l_linenumber FROM lineitem")
def log_transform(spark, sf_dir):
    return rounded(LogTransformer(["l_discount", "l_quantity"]).fit_transform(t(spark, sf_dir, "lineitem").select("l_discount", "l_quantity", "l_orderkey", "l_linenumber")))


@query('SELECT *, 1 AS "Constante" FROM nation')
def add_constant(spark, sf_dir):
    return AddConstante().fit_transform(t(spark, sf_dir, "nation"))


@query("SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'O')::INT AS \"O\", (o_orderstatus = 'P')::INT AS \"P\" FROM orders")
def fixed_effect(spark, sf_dir):
    return AddFixedEffect("o_orderstatus", no_trap="F").fit_transform(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@query("SELECT o_orderkey, o_orderstatus, s, " + ", ".join(f"""(o_orderstatus = '{a}' AND s = '{b}')::INT AS "{a} - {b}" """ for a in _STATUS[1:] for b in ("big", "small")) + " FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS s FROM orders)")
def interaction(spark, sf_dir):
    df = t(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS s")
    return AddInteraction(["o_orderstatus", "s"], ["F"]).fit_transform(df)


@query()
def kmeans_labels(spark, sf_dir):
    """Sizes and means of clusters, numbered by their centres."""
    from pyspark.ml.clustering import KMeans

    df = t(spark, sf_dir, "part").select("p_size", "p_retailprice")
    out = ClusteringTransformer(KMeans(k=3, seed=1)).fit_transform(StandardScalerTransformer().fit_transform(df))
    return out.groupBy("labels").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("p_size"), F.round(F.avg("p_retailprice"), 6).alias("p_retailprice")).orderBy("labels")


# estimators


def _numbered(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", F.lit(1).alias("Constante"))


@query("""SELECT 'Constante' AS variable, round(regr_intercept(l_extendedprice, l_quantity), 4) AS "Coefficients" FROM lineitem
  UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def ols_simple(spark, sf_dir):
    e = LeastSquaresEstimator().fit(_numbered(spark, sf_dir), ["Constante", "l_quantity"], "l_extendedprice")
    return rounded(e.summary().select("variable", "Coefficients"), 4)


_N = "n - 2"


@query("""WITH s AS (SELECT count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem)
  SELECT round(r2, 8) AS "R2", round(1 - (1 - r2) * (n - 1) / (n - 2), 8) AS "R2Adj" FROM s""")
def ols_r2(spark, sf_dir):
    return rounded(LeastSquaresEstimator().fit(_numbered(spark, sf_dir), ["l_quantity", "Constante"], "l_extendedprice").rsquared(), 8)


@query("""WITH m AS (SELECT sum(l_quantity * l_tax) / sum(l_quantity) AS a, sum(l_quantity * l_discount) / sum(l_quantity) AS b, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS y FROM lineitem),
  g AS (SELECT sum(l_quantity * (l_tax - a) ** 2) AS aa, sum(l_quantity * (l_discount - b) ** 2) AS bb, sum(l_quantity * (l_tax - a) * (l_discount - b)) AS ab,
    sum(l_quantity * (l_tax - a) * (l_extendedprice - y)) AS ay, sum(l_quantity * (l_discount - b) * (l_extendedprice - y)) AS cy FROM lineitem, m),
  k AS (SELECT (ay * bb - ab * cy) / (aa * bb - ab * ab) AS ka, (cy * aa - ab * ay) / (aa * bb - ab * ab) AS kb FROM g)
  SELECT 'Constante' AS variable, round(y - ka * a - kb * b, 4) AS "Coefficients" FROM m, k UNION ALL SELECT 'l_tax', round(ka, 4) FROM k UNION ALL SELECT 'l_discount', round(kb, 4) FROM k""")
def wls_two_regressors(spark, sf_dir):
    e = LeastSquaresEstimator().fit(_numbered(spark, sf_dir), ["Constante", "l_tax", "l_discount"], "l_extendedprice", sample_weight="l_quantity")
    return rounded(e.summary().select("variable", "Coefficients"), 4)


@query(estimator_sql.ols_summary())
def ols_summary(spark, sf_dir):
    """With t-probabilities and intervals."""
    return rounded(LeastSquaresEstimator().fit(_numbered(spark, sf_dir), ["Constante", "l_quantity", "l_tax"], "l_extendedprice").summary(), 4)


@query("""SELECT 'Constante' AS variable, round(regr_intercept(y, x), 4) AS "Coefficients" FROM d UNION ALL SELECT 'l_quantity', round(regr_slope(y, x), 4) FROM d""".replace(" FROM d", " FROM (SELECT l_extendedprice AS y, ln(l_quantity) AS x FROM lineitem WHERE l_discount > 0.02)"))
def estimate_with_stages(spark, sf_dir):
    class Logged(LogTransformer):
        def transform(self, df):
            return AddConstante().transform(super().transform(df)).filter("l_discount > 0.02").drop("l_discount")

    s, _ = estimate_summarize(LeastSquaresEstimator(), t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", transformer=Logged(["l_quantity"]))
    return rounded(s.select("variable", "Coefficients"), 4)


@query("""WITH k AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem),
  m AS (SELECT avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') - avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R') AS gap, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') - avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS dx FROM lineitem)
  SELECT 'Gap' AS effect, round(gap, 4) AS decomposition FROM m UNION ALL SELECT 'Explained Effect', round(dx * b, 4) FROM m, k UNION ALL SELECT 'Unexplained Effect', round(gap - dx * b, 4) FROM m, k""")
def oaxaca_pooled(spark, sf_dir):
    df = _numbered(spark, sf_dir).withColumn("g", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(OaxacaBlinder("g").fit(df, ["Constante", "l_quantity"], "l_extendedprice").decompose(), 4)


@query("""SELECT 'm' AS variable, round(regr_slope(y, x), 6) AS "Coefficients" FROM (
  SELECT o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS y, month(o_orderdate) - avg(month(o_orderdate)) OVER (PARTITION BY o_custkey) AS x FROM orders)""")
def panel_within(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("m", F.month("o_orderdate"))
    e = PanelLeastSquaresEstimator(entity_effects=True).fit(df, ["m"], "o_totalprice", "o_custkey", "o_year")
    return rounded(e.summary().select("variable", "Coefficients"))


@query(estimator_sql.panel_two_way())
def panel_two_way(spark, sf_dir):
    """Both effects on an unbalanced panel, with the five kinds of R2."""
    df = orders(spark, sf_dir).withColumn("m", F.month("o_orderdate"))
    return rounded(PanelLeastSquaresEstimator(True, True).fit(df, ["m"], "o_totalprice", "o_custkey", "o_year").rsquared())


def _quality(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.ln("n_chars").alias("size"), (F.col("lang") == "en").cast("int").alias("en"))
    return t(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("Constante", F.lit(1))


@query(estimator_sql.LOGIT)
def logit(spark, sf_dir):
    return rounded(LogitClassifier().fit(_quality(spark, sf_dir), ["Constante", "size", "en"], "quality").summary())


@query(estimator_sql.PROBIT)
def probit(spark, sf_dir):
    return rounded(ProbitClassifier().fit(_quality(spark, sf_dir), ["Constante", "size", "en"], "quality").summary())


@query(estimator_sql.logit_l1(5.0))
def logit_l1(spark, sf_dir):
    return rounded(LogitClassifier(regularized=True, alpha=5.0).fit(_quality(spark, sf_dir), ["Constante", "size", "en"], "quality").summary())


@query(estimator_sql.logit_margeff())
def margeff(spark, sf_dir):
    return rounded(LogitClassifier().fit(_quality(spark, sf_dir), ["Constante", "size", "en"], "quality").margeff())


@query("""WITH f AS (SELECT *, l_orderkey % 5 AS fold FROM lineitem), b AS (SELECT k.fold, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY k.fold)
  SELECT l_orderkey, fold::INT AS fold, round(i + s * l_quantity, 4) AS prediction FROM f JOIN b USING (fold)""")
def crossval_ols(spark, sf_dir):
    df = _numbered_rows(spark, sf_dir)
    out = crossval_predict(LeastSquaresEstimator(), df, ["Constante", "l_quantity"], "l_extendedprice", "l_orderkey", fold_col="fold")
    return rounded(out, 4)


def _numbered_rows(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", F.lit(1).alias("Constante"), (F.col("l_orderkey") % 5).alias("fold"))


@query()
def bootstrap_ci(spark, sf_dir):
    """Out-of-fold predictions with intervals over 20 draws."""
    return crossval_predict(LeastSquaresEstimator(), _numbered_rows(spark, sf_dir), ["Constante", "l_quantity"], "l_extendedprice", "l_orderkey", fold_col="fold", compute_confidence_interval=True, n_iterations_boostrap=20, bootstrap_size=0.8, alpha=0.95)


# windows of a stream (the same plan serves a batch)


@query("""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, round(sum(value), 4) AS value_sum, round(avg(value), 4) AS value_mean, count(value) AS value_count FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    out = rounded(windowed_statistics(t(spark, sf_dir, "events"), "ts", "1 hour", ["value"], ["event_type"]), 4)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
