"""Vectors of tables: which are usable, and as matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector that is not null, holds only finite numbers, not
    only zeros, and has the length most vectors have (ties: the longer)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = (
        rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    )
    lengths = good.groupBy(F.size("v").alias("n")).count()
    first = lengths.orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return good.filter(F.size("v") == (first.n if first else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def as_list(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


def sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows with the smallest hash of their id, on the driver: ids and unit vectors."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    x = matrix(got["v"])
    return got["id"].to_numpy(), unit(x) if len(x) else x
