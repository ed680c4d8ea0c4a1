"""Elementwise and vector functions over array columns. Arrays of unequal length are cut to the shorter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_length(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def array_sum(a: Column, b: Column) -> Column:
    """Elementwise sum."""
    a, b = _same_length(a, b)
    return F.zip_with(a, b, lambda x, y: x + y)


def array_times_optional(a: Column, b: Column) -> Column:
    """Elementwise product; a itself where b is null."""
    x, y = _same_length(a, b)
    return F.when(b.isNull(), a).otherwise(F.zip_with(x, y, lambda p, q: p * q))


def dot(a: Column, b: Column) -> Column:
    a, b = _same_length(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean_distance(a: Column, b: Column) -> Column:
    a, b = _same_length(a, b)
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one of them is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def row_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
