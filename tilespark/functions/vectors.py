"""Column functions over vectors (arrays of numbers); arithmetic is in double, summed in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length: cosine for unit vectors."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / n)


def has_bad_component(v: Column) -> Column:
    return F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def largest(v: Column) -> Column:
    """The largest absolute component."""
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))


def quantised(v: Column, scale: Column) -> Column:
    """Symmetric int8 codes; ties round to even."""
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(x / scale, 0))).cast("tinyint"))


def dequantised(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda x: x.cast("double") * scale)


def projected(v: Column, components: Column) -> Column:
    """Coordinates of a vector in the basis given by the rows of ``components``, without centring."""
    return F.transform(components, lambda row: dot(v, row))
