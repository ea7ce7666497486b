"""Vectors as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero; vectors of different length are an error."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different length"))
    size = norm(a) * norm(b)
    return F.when(same.isNotNull(), None).when(size == 0, 0.0).otherwise(dot(a, b) / size)
