"""Totals ahead of each element of an array, in n * sqrt(n) steps: nothing grows by appending, as it would in a fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a lambda over an array that holds it alone."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefixed(values: Column, total: Callable[[Column], Column], none: Column) -> Column:
    """A struct (v, k, before) from which ``ahead`` gives ``total`` over the values ahead of a place.

    ``before`` holds the totals ahead of each block of k values, k the root of their number.
    """
    blocks = lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(b["v"]) - 1) / b["k"]).cast("int"), F.lit(0))), lambda j: total(F.slice(b["v"], j * b["k"] + 1, b["k"])))
    upto = lambda t: F.transform(t, lambda _, j: F.when(j > 0, total(F.slice(t, 1, j))).otherwise(none))
    sized = F.struct(values.alias("v"), F.ceil(F.sqrt(F.greatest(F.size(values), F.lit(1)))).cast("int").alias("k"))
    return let(sized, lambda b: F.struct(b["v"].alias("v"), b["k"].alias("k"), let(blocks(b), upto).alias("before")))


def ahead(p: Column, i: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """The total over the first i values of ``prefixed``."""
    j = F.floor(i / p["k"]).cast("int")
    rest = i - j * p["k"]
    return F.when(rest > 0, join(F.element_at(p["before"], j + 1), total(F.slice(p["v"], j * p["k"] + 1, rest)))).otherwise(F.element_at(p["before"], j + 1))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)
