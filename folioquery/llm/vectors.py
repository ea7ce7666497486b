"""Vectors as packed binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, embedding array<double>) of vectors without null or non-finite components.

    Vectors of another length than the most frequent one (the longest of these) take no part either.
    """
    x = F.col(col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.where("size(embedding) > 0").where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (length["d"] if length else 0))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """The rows of a binary column of one width, as a matrix."""
    if not len(column):
        return np.zeros((0, 1), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def rows_of(column: pa.ListArray, dtype) -> np.ndarray:
    """The rows of a list column of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype)
