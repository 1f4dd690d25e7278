"""Vector math on array columns, in double precision whatever they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAME_PERSON = 1.1


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_unit(a: Column, b: Column) -> Column:
    """Euclidean distance of unit vectors, by their inner product; null where there is no vector."""
    return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(a, b))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    size = norm(a) + 1e-12
    return F.transform(doubles(a), lambda x: x / size)


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))
