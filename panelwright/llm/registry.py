"""Queries of the subpackage and their SQL twins, filled by the operator modules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame``."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """Free memory goes back to the system: workers are reused, and one keeps what its largest task took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, a longer text by itself: bounds what a worker holds."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()
