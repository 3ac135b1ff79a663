"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir

__all__ = ["binary", "cut", "fresh", "held", "new_folder", "packed", "quoted", "shared_dir", "small_batches", "strings", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def packed(df: DataFrame, per: int = 100_000) -> DataFrame:
    """A table of narrow rows, materialised, in partitions of about so many rows: what is small doesn't stay dealt over as many tasks as its source."""
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // per)))


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores in front as long as a column has it (names differ without regard to case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def binary(batch: pa.RecordBatch, k: int) -> list[bytes]:
    """Column k as UTF-8 bytes; null is empty."""
    col = batch.column(k)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, k: int) -> list[str]:
    return [x or "" for x in batch.column(k).to_pylist()]


_HELD: dict = {}


def held(key, make: Callable):
    """What make() gives, kept by this worker between the tasks of one operator; only one such value is kept."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _settle() -> None:
    """Memory that earlier tasks of this worker have freed goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def small_batches(batches, mb: float = 8.0, keep: bool = False):
    """The same rows in batches of about so many MB at most, so that very long texts don't pile up. Workers serve one stage after the other: without keep, what
    held() has kept goes."""
    if not keep:
        _HELD.clear()
    _settle()
    for b in batches:
        parts = max(1, min(b.num_rows, int(b.nbytes / (mb * 1e6)) + 1))
        step = -(-b.num_rows // parts) if b.num_rows else 1
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
