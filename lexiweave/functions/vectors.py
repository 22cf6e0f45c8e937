"""Vectors as array<double> columns; everything stays in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def normalized(a: Column, *, floor: float = 1e-12) -> Column:
    """a over its length, at least `floor`."""
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(floor)))


def normalized_by_sum(a: Column, *, eps: float = 1e-12) -> Column:
    """a over its length plus eps."""
    return F.transform(a, lambda x: x / (norm(a) + F.lit(eps)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where one side is constant (corr would divide by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
