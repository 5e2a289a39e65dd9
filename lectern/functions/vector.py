"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine similarity; ``zero`` where either vector has no length (segmentation takes 1, coverage 0)."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(zero))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def parse(literal: Column) -> Column:
    """``[1,2]`` as an array of doubles; null where it does not parse."""
    return F.from_json(literal, "array<double>")
