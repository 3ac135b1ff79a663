"""Group statistics with subtotals: a specification of operations is compiled to one aggregation over grouping sets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TOTAL, all_of, col, drop_missing, nan_to_null, require, truthy
from ..functions.distinct import distinct_counts
from ..functions.weighted import expand, grouped_quantiles, grouped_weighted_quantiles

PLAIN = ("sum", "mean", "median", "nunique", "count", "any", "all", "majority", "count_effectif", "max_sum_effectif")
WITH_PARAMETERS = {"quantile": ("q",), "prop": ("var_ref",), "inf_threshold": ("var_threshold", "threshold")}


@dataclass(frozen=True)
class Op:
    """One operation on some columns."""

    name: str
    params: tuple = ()
    columns: tuple[str, ...] | None = field(default=None)

    def __getitem__(self, key):
        return dict(self.params)[key]


def parse_spec(spec, interest: list[str]) -> list[Op]:
    """Of a list (each operation on all columns of interest, in their order) or a mapping operation -> columns (those of interest
    among them, in alphabetical order). An operation is a name, or a name with parameters. Others raise ValueError."""
    if isinstance(spec, Mapping):
        pairs = [(op, tuple(sorted(set(interest) & set([cols] if isinstance(cols, str) else cols or ())))) for op, cols in spec.items()]
    elif isinstance(spec, (list, tuple)):
        pairs = [(op, tuple(interest)) for op in spec]
    else:
        raise ValueError("operations are a list, or a mapping of operations to columns")
    out = []
    for op, columns in pairs:
        name, params = (op, {}) if isinstance(op, str) else op
        needed = WITH_PARAMETERS.get(name, ())
        if name not in PLAIN and name not in WITH_PARAMETERS:
            raise ValueError(f"unknown operation {name!r}")
        if missing := [p for p in needed if p not in params]:
            raise ValueError(f"{name} needs {missing}")
        out.append(Op(name, tuple(params.items()), columns))
    return out


class StatDesGroupBy:
    """Statistics of columns of interest by groups, weighted if a weight is named.

    data_source is pruned to the columns used; NaN counts as null. dropna drops rows with any null among them.
    Groups with a null key stay groups of their own; in subtotals the label of total stands for all values of a key.
    """

    def __init__(self, data_source: DataFrame, list_var_groupby: list[str] | None, list_var_of_interest: list[str], var_individu: str | None = None, var_entreprise: str | None = None, var_weights: str | None = None, dropna: bool = False, total_label: str = TOTAL):
        self.keys = list(list_var_groupby or [])
        self.interest = list(list_var_of_interest)
        self.individual, self.enterprise, self.weights, self.total = var_individu, var_entreprise, var_weights, total_label
        used = sorted({*self.keys, *self.interest, *(x for x in (var_individu, var_entreprise, var_weights) if x)})
        require(data_source, used)
        self.data = nan_to_null(data_source.select(*map(col, used)))
        if dropna:
            self.data = drop_missing(self.data)

    # one operation

    def _weighted(self, v: str) -> Column:
        return col(v).cast("double") * col(self.weights).cast("double") if self.weights else col(v)

    def _share(self, top: Column, bottom: Column) -> Column:
        return F.try_divide(top.cast("double"), bottom.cast("double"))

    def _compile(self, ops: list[Op]) -> tuple[list[tuple[str, Column]], dict[str, list[Column]], dict[str, list[tuple[str, float]]], list[tuple[str, str]]]:
        """(plain aggregates, distinct counts, quantiles by variable, majorities), each with its output name, in the order of output.
        A distinct count has one expression, or two of which the share of the counts is wanted."""
        plain, distinct, quantiles, majorities, order = [], {}, {}, [], []
        w = self.weights

        def add(name, expr):
            if name not in order:
                order.append(name)
                plain.append((name, expr))

        def add_distinct(name, *exprs):
            if name not in order:
                order.append(name)
                distinct[name] = list(exprs)

        for op in ops:
            if op.name == "count_effectif":
                for who in (self.individual, self.enterprise):
                    if who:
                        add_distinct(f"{who}_nunique", col(who))
                continue
            for v in op.columns:
                c = col(v)
                if op.name == "sum":
                    total = F.sum(c) if v == w or not w else F.sum(self._weighted(v))
                    add(f"{v}_sum", F.coalesce(total, F.lit(0)))
                elif op.name == "mean":
                    # the weights of rows without a value count in the denominator
                    add(f"{v}_mean", self._share(F.coalesce(F.sum(self._weighted(v)), F.lit(0.0)), F.sum(col(w).cast("double"))) if w else F.avg(c))
                elif op.name in ("median", "quantile"):
                    q = 0.5 if op.name == "median" else op["q"]
                    name = f"{v}_q{q}"
                    if name not in order:
                        order.append(name)
                        quantiles.setdefault(v, []).append((name, q))
                elif op.name == "nunique":
                    add_distinct(f"{v}_nunique", c)
                elif op.name == "count":
                    add(f"{v}_count", F.count(c))
                elif op.name == "any":
                    add(f"{v}_any", F.coalesce(F.bool_or(truthy(self.data, v)), F.lit(False)))
                elif op.name == "all":
                    add(f"{v}_all", F.coalesce(F.bool_and(truthy(self.data, v)), F.lit(True)))
                elif op.name == "prop":
                    r = op["var_ref"]
                    require(self.data, [r])
                    add(f"{v}_{r}_prop", self._share(F.sum(self._weighted(v)), F.sum(self._weighted(r))))
                elif op.name == "majority":
                    name = f"{v}_majority"
                    if name not in order:
                        order.append(name)
                        majorities.append((name, v))
                elif op.name == "inf_threshold":
                    t, s = op["var_threshold"], op["threshold"]
                    require(self.data, [t])
                    add_distinct(f"{v}_inf_{s}", F.when(col(t) < s, c), c)
                elif op.name == "max_sum_effectif":
                    for who in (self.individual, self.enterprise):
                        if who:
                            add(f"{v}_{who}_max/sum", self._share(F.max(self._weighted(v)), F.sum(self._weighted(v))))
        self._order = order
        return plain, distinct, quantiles, majorities

    # grouping sets: a tuple of flags, True where the key stays

    def _sets(self, level: str) -> list[tuple[bool, ...]]:
        k = len(self.keys)
        every = list(product((True, False), repeat=k))
        return {"base": every[:1], "all": every, "under": every[1:-1] if k else [], "total": every[-1:]}[level]

    def _run(self, spec, level: str) -> DataFrame:
        plain, distinct, quantiles, majorities = self._compile(parse_spec(spec, self.interest))
        order, sets = self._order, self._sets(level)
        if not order:
            raise ValueError("no operation applies to these columns")
        keys = [f"_k{i}" for i in range(len(self.keys))]
        # the keys get names of their own, so that a key can be aggregated too
        rows = self.data.select("*", *(col(k).alias(a) for k, a in zip(self.keys, keys, strict=True)))
        if not sets:
            sets, empty = self._sets("base"), True
        else:
            empty = False
        gid = {s: sum(1 << (len(s) - 1 - i) for i, stays in enumerate(s) if not stays) for s in sets}
        exprs = [e.alias(f"_a{order.index(n)}") for n, e in plain] or [F.count(F.lit(1)).alias("_n")]
        if not plain and keys:
            # groups alone: distinct keys are copied per set, rows aren't
            out = expand(rows.select(*keys).distinct(), keys, {s: gid[s] for s in sets}).distinct()
        elif len(sets) == 1 and all(sets[0]) and keys:
            out = rows.groupBy(*keys).agg(*exprs).withColumn("_g", F.lit(0))
        elif len(sets) == 1 and not any(sets[0]):
            out = rows.agg(*exprs).select(*(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys), "*", F.lit(gid[sets[0]]).alias("_g"))
        elif len(sets) == 1 << len(keys):
            out = rows.cube(*keys).agg(F.grouping_id().cast("int").alias("_g"), *exprs)
        else:
            out = rows.groupingSets([[F.col(k) for k, stays in zip(keys, s, strict=True) if stays] for s in sets], *map(F.col, keys)).agg(F.grouping_id().cast("int").alias("_g"), *exprs)
        names = {n: f"_a{order.index(n)}" for n, _ in plain}
        at, w = ["_g", *keys], (col(self.weights).cast("double") if self.weights else F.lit(1.0))
        grouped = {s: gid[s] for s in sets}
        if distinct:
            parts = {f"_a{order.index(n)}_{i}": c for n, exprs in distinct.items() for i, c in enumerate(exprs)}
            for n, part in zip(parts, distinct_counts(rows, keys, grouped, parts), strict=True):
                out = self._join(out, part, at, {n: n})
            for n, exprs in distinct.items():
                names[n] = f"_a{order.index(n)}"
                counts = [F.coalesce(F.col(f"{names[n]}_{i}"), F.lit(0).cast("long")) for i in range(len(exprs))]
                out = out.withColumn(names[n], counts[0] if len(counts) == 1 else self._share(*counts))
        for v, asked in quantiles.items():
            qs, one = [q for _, q in asked], rows.select(*keys, col(v).alias("_v"), w.alias("_w"))
            part = grouped_weighted_quantiles(one, keys, "_v", "_w", qs, sets=grouped) if self.weights else grouped_quantiles(one, keys, "_v", qs, sets=grouped)
            out = self._join(out, part, at, {f"_a{order.index(n)}": f"q_{i}" for i, (n, _) in enumerate(asked)})
            names |= {n: f"_a{order.index(n)}" for n, _ in asked}
        for n, v in majorities:
            # counts by value are taken before a copy per grouping set
            own = rows.filter(col(v).isNotNull()).groupBy(*keys, col(v).alias("_x")).agg(F.sum(w).alias("_t"))
            sums = expand(own, keys, grouped).groupBy(*at, "_x").agg(F.sum("_t").alias("_t")).filter("_t is not null")
            part = sums.groupBy(*at).agg(F.min(F.struct((-F.col("_t")).alias("t"), F.col("_x").alias("x")))["x"].alias("m"))
            out = self._join(out, part, at, {f"_a{order.index(n)}": "m"})
            names[n] = f"_a{order.index(n)}"
        if empty:
            out = out.filter(F.lit(False))
        gone = [F.col("_g").bitwiseAND(1 << (len(keys) - 1 - i)) != 0 for i in range(len(keys))]
        sort = [x for i, k in enumerate(keys) for x in (gone[i], F.col(k).asc_nulls_last())]
        if level != "base":
            labelled = [F.when(gone[i], self.total).otherwise(F.col(k).cast("string")).alias(name) for i, (k, name) in enumerate(zip(keys, self.keys, strict=True))]
        else:
            labelled = [F.col(k).alias(name) for k, name in zip(keys, self.keys, strict=True)]
        out = out.orderBy(*sort) if sort else out
        return out.select(*labelled, *(F.col(names[n]).alias(n) for n in order))

    @staticmethod
    def _join(left: DataFrame, right: DataFrame, at: list[str], take: dict[str, str]) -> DataFrame:
        right = right.select(*(F.col(k).alias(f"{k}_r") for k in at), *(F.col(x).alias(n) for n, x in take.items()))
        return left.join(right, all_of(left[k].eqNullSafe(right[f"{k}_r"]) for k in at), "left").drop(*(f"{k}_r" for k in at))

    # drivers

    def iterate_without_total(self, spec) -> DataFrame:
        """The groups, sorted by their keys."""
        return self._run(spec, "base" if self.keys else "total")

    def iterate_with_total(self, spec) -> DataFrame:
        """Groups, all subtotals and the total; keys ascend, and a total comes after its parts."""
        return self._run(spec, "all" if self.keys else "total")

    def add_under_total(self, spec) -> DataFrame:
        """Subtotals only: some of the keys are totals, not all."""
        return self._run(spec, "under")

    def add_total(self, spec) -> DataFrame:
        """The row of the whole table."""
        return self._run(spec, "total")

    def iterate_operations(self, spec) -> DataFrame:
        return self.iterate_without_total(spec)

    def __getattr__(self, name):
        """Each operation on its own: sum(), mean(), ... by the groups, on some columns of interest or all."""
        if name.startswith("_") or name not in PLAIN and name not in WITH_PARAMETERS:
            raise AttributeError(name)

        def one(columns: list[str] | None = None, **params) -> DataFrame:
            op = (name, params) if params else name
            chosen = list(columns or self.interest)
            was, self.interest = self.interest, chosen
            try:
                return self.iterate_without_total([op])
            finally:
                self.interest = was

        return one
