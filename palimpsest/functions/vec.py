"""Vectors as arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - cosine(a, b)) / 2))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def clip(a: Column, most: float) -> Column:
    """Scaled down to a norm of at most ``most``."""
    n = norm(a)
    return F.transform(_d(a), lambda x: F.when(n > most, x * (F.lit(most) / n)).otherwise(x))


def valid(a: Column, dim: int) -> Column:
    return F.coalesce((F.size(a) == dim) & F.forall(_d(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)), F.lit(False))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])
