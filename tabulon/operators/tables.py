"""Operations on tables of results: order with totals, shares, nesting, stars, counts of modalities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import TOTAL, all_of, any_of, col, require


def sort_with_total(df: DataFrame, keys: list[str], label: str = TOTAL) -> DataFrame:
    """By the keys, each total after its parts."""
    return df.orderBy(*(x for k in keys for x in (F.coalesce(col(k) == label, F.lit(False)), col(k).asc_nulls_last())))


def divide_by_total(df: DataFrame, list_var_groupby: list[str], list_var_divide: list[str], list_var_of_interest: list[str], modality: str | Mapping[str, str] = TOTAL) -> DataFrame:
    """Keys and columns of interest, these divided by those of the row with the same groupby keys in which all divide keys are the modality (one for all, or one for each)."""
    require(df, [*list_var_groupby, *list_var_divide, *list_var_of_interest])
    told = {k: modality[k] if isinstance(modality, Mapping) else modality for k in list_var_divide}
    ref = df.filter(all_of(col(k) == m for k, m in told.items())).select(*(col(k).alias(f"_r{i}") for i, k in enumerate(list_var_groupby)), *(col(v).alias(f"_v{i}") for i, v in enumerate(list_var_of_interest)))
    keys = [c for c in df.columns if c in {*list_var_groupby, *list_var_divide}]
    joined = df.join(ref, all_of(col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(list_var_groupby)), "left")
    return joined.select(*map(col, keys), *(F.try_divide(col(v).cast("double"), F.col(f"_v{i}").cast("double")).alias(v) for i, v in enumerate(list_var_of_interest)))


def nest_groupby(df: DataFrame, keys: list[str], modality: str = TOTAL) -> DataFrame:
    """Drop levels that say nothing: where, under a prefix of the keys, the next one has two values of which one is the modality, all its
    rows get the modality; of rows with the same keys then, the one that had it stays. With one key the same holds for the whole table."""
    require(df, keys)
    out = df.select("*", *(col(k).alias(f"_o{i}") for i, k in enumerate(keys)))
    for i in range(1, len(keys)) if len(keys) > 1 else (0,):
        prefix = [f"_o{j}" for j in range(i)]
        x = F.col(f"_o{i}")
        told = out.groupBy(*prefix).agg(((F.count_distinct(x) == 2) & F.bool_or(F.coalesce(x == modality, F.lit(False)))).alias("_fold"))
        told = told.select(*(F.col(p).alias(f"{p}_r") for p in prefix), "_fold")
        same = all_of(F.col(p).eqNullSafe(F.col(f"{p}_r")) for p in prefix)
        out = out.join(told, same, "left").withColumn(keys[i], F.when(F.col("_fold"), modality).otherwise(col(keys[i]))).drop("_fold", *(f"{p}_r" for p in prefix))
    # of equal keys: the row with the most original totals, then a fixed order
    totals = sum((F.coalesce(F.col(f"_o{i}") == modality, F.lit(False)).cast("int") for i in range(len(keys))), F.lit(0))
    first = Window.partitionBy(*map(col, keys)).orderBy(totals.desc(), *(F.col(f"_o{i}") for i in range(len(keys))))
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*map(col, df.columns))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, " (***)").when(p < 0.05, " (**)").when(p < 0.1, " (*)").otherwise(" ()")


def apply_stars(coef: Column, p: Column) -> Column:
    """A coefficient as text with its stars: *** under 1 %, ** under 5 %, * under 10 %."""
    return F.concat(coef.cast("string"), stars(p))


def star_text(coef: str, p: float | None) -> str:
    """apply_stars for one value: '0.25', .02 -> '0.25 (**)'."""
    mark = "" if p is None or p != p else "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""
    return f"{coef} ({mark})"


def _text(c: Column, digits: int) -> Column:
    """As Python writes a rounded float: without trailing zeros, but with one decimal at least."""
    fixed = F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.bround(c, digits) + 0.0))
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def convert_pvalues_to_stars(df: DataFrame, var_coef: str = "Coefficients", var_p_value: str = "P-valeurs", is_percent: bool = False) -> DataFrame:
    """df with "coef - p": the rounded coefficient (in percent, or with two decimals), a decimal comma, and stars."""
    require(df, [var_coef, var_p_value])
    c = col(var_coef).cast("double")
    text = F.concat(_text(c * 100, 1), F.lit("%")) if is_percent else _text(c, 2)
    return df.withColumn(f"{var_coef} - {var_p_value}", F.concat(F.replace(F.coalesce(text, F.lit("nan%" if is_percent else "nan")), F.lit("."), F.lit(",")), stars(col(var_p_value))))


def count_effectif_modalite(pairs: list[tuple[str, str]], df: DataFrame, var_individu: str) -> DataFrame:
    """For each (variable, modality) the number of individuals that have it, and for "Intersection" of those rows that have all of them."""
    require(df, [var_individu, *(v for v, _ in pairs)])
    who = col(var_individu)
    conditions = [col(v) == m for v, m in pairs]
    # one row per individual, so that its rows are not copied once per condition
    each = df.filter(who.isNotNull()).groupBy(who.alias("_who")).agg(*(F.bool_or(c).alias(f"n{i}") for i, c in enumerate([*conditions, all_of(conditions)])))
    counts = each.agg(*(F.count_if(f"n{i}").alias(f"n{i}") for i in range(len(conditions) + 1)))
    labels = [*((v, str(m)) for v, m in pairs), ("Intersection", "Intersection")]
    rows = F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(m).alias("modalite_ref"), F.col(f"n{i}").alias("nombre_individus")) for i, (v, m) in enumerate(labels)))
    return counts.select(F.inline(rows))


def suppress_small(df: DataFrame, counts: list[str] | None = None, n_min: int | None = None, shares: list[str] | None = None, p_max: float | None = None, values: list[str] | None = None) -> DataFrame:
    """Primary disclosure control: values become null where a count is under n_min, or a dominance share is over p_max. Both limits are the user's."""
    if (counts and n_min is None) or (shares and p_max is None):
        raise ValueError("n_min goes with counts, p_max with shares")
    hit = any_of([*(col(c) < n_min for c in counts or []), *(col(s) > p_max for s in shares or [])])
    hit = F.coalesce(hit, F.lit(False))
    return df.select(*(F.when(~hit, col(c)).alias(c) if c in (values or []) else col(c) for c in df.columns), hit.alias("secret"))
