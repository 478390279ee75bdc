"""Vector functions as column expressions; sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; null for a vector of length zero."""
    length = norm(a)
    return F.when(length > 0, F.transform(doubles(a), lambda x: x / length))


def strict_unit(a: Column) -> Column:
    """The vector at length one; a vector of length zero fails the job."""
    return F.coalesce(unit(a), F.when(a.isNotNull(), F.raise_error(F.lit("zero vector")).cast("array<double>")))
