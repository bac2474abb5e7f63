"""Vector functions over ARRAY<DOUBLE> columns.

Vectors of different lengths are an error where both are given (ANSI `raise_error`), as the operands are typed data,
not documents; use same_size() to turn it into an error row first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(*components: Column | str) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in components])


def same_size(v: Column, w: Column) -> Column:
    return F.size(v) == F.size(w)


def rounded(x: Column, digits: int) -> Column:
    """A double to that many decimals as SQL twins round it: times a power of ten to the nearest whole number, halves
    away from zero; zero keeps the sign (Spark's round goes by decimals and has no -0.0). Beyond that power: itself."""
    power = 10.0**digits
    y = x * power
    even = F.rint(y)
    off = y - even
    nearest = F.when((F.abs(off) == 0.5) & (off * y > 0), even + off * 2).otherwise(even)
    return F.when(F.abs(y) < float("inf"), nearest / power).otherwise(x)


def _pairs(v: Column, w: Column, f) -> Column:
    unequal = F.raise_error(F.lit("the vectors have different lengths")).cast("array<double>")
    return F.when(same_size(v, w), F.zip_with(v, w, f)).when(v.isNotNull() & w.isNotNull(), unequal)


def scale(v: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(v, lambda x: x * by)


def add(v: Column, w: Column) -> Column:
    return _pairs(v, w, lambda a, b: a + b)


def sub(v: Column, w: Column) -> Column:
    return _pairs(v, w, lambda a, b: a - b)


def dot(v: Column, w: Column) -> Column:
    return F.aggregate(_pairs(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def distance(v: Column, w: Column) -> Column:
    return F.sqrt(F.aggregate(_pairs(v, w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
