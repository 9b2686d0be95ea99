"""Vectors as arrays; plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalised(x: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    scaled = lambda n: F.transform(x, lambda v: v.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.get(F.transform(F.array(norm(x)), scaled), F.lit(0))  # the norm is made once a vector


def cosine(x: Column, y: Column) -> Column:
    n = norm(x) * norm(y)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(x, y) / n)
