"""Vectors as array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def finite(v: Column) -> Column:
    """Whether a vector is there and holds neither null nor NaN."""
    return v.isNotNull() & ~F.exists(_doubles(v), lambda x: x.isNull() | F.isnan(x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero, null or NaN vector."""
    return F.when(finite(a) & finite(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(_doubles(v), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
