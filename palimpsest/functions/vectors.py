"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column, unit: bool = False) -> Column:
    """1 - cosine; ``unit`` leaves the norms out where both are known to be 1. Null if either is null or zero."""
    if unit:
        return 1 - dot(a, b)
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def similarity(distance: Column) -> Column:
    return 1 - distance
