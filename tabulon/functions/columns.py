"""Column helpers: quoting, NaN as null, names, and the reserved "Total" label."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOTAL = "Total"
SEPARATOR = " - "


def col(name: str) -> Column:
    """A column by its whole name; names made here have dots, slashes and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"no such column: {missing}; there are {df.columns}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere here, while Spark takes it for a large value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns)) if floats else df


def drop_missing(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Rows without a null in some columns, or in any."""
    return df.filter(all_of(col(c).isNotNull() for c in (df.columns if names is None else names)))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def truthy(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return col(name)
    return col(name) != ("" if isinstance(kind, T.StringType) else 0)


def with_suffix(names: Iterable[str], suffix: str) -> dict[str, str]:
    """Each name with the suffix: apple -> apple_fruit."""
    return {n: f"{n}{suffix}" for n in names}


def split_dummy(name: str, separator: str = SEPARATOR) -> tuple[str, str]:
    """'Color - Blue' -> ('Color', 'Blue'); only the first separator splits."""
    category, _, modality = name.partition(separator)
    return category, modality


def split_dummy_column(c: Column, separator: str = SEPARATOR) -> tuple[Column, Column]:
    at = F.instr(c, separator)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.substring(c, at + len(separator), F.char_length(c))).otherwise("")


class FrozenDict(Mapping):
    """An immutable, hashable mapping, for operations with parameters as keys of a specification."""

    def __init__(self, *args, **kwargs):
        self._items = dict(*args, **kwargs)

    def __getitem__(self, key):
        return self._items[key]

    def __iter__(self):
        return iter(self._items)

    def __len__(self):
        return len(self._items)

    def __hash__(self):
        return hash(frozenset(self._items.items()))

    def __eq__(self, other):
        return isinstance(other, Mapping) and self._items == dict(other)

    def __repr__(self):
        return f"FrozenDict({self._items})"
