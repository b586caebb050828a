"""Array arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def combine(a: Column, ka: Column, b: Column, kb: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * ka + y * kb)


def first_axis(a: Column) -> Column:
    """The unit vector e0 with as many entries as ``a``."""
    return F.transform(a, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))


def unit(a: Column) -> Column:
    """Direction of ``a``; the origin gets e0."""
    n = norm(a)
    return F.when(n == 0, first_axis(a)).otherwise(F.transform(a, lambda x: x / n))


def rounded(a: Column, digits: int) -> Column:
    return F.transform(a, lambda x: F.round(x, digits) + F.lit(0.0))
