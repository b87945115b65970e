"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of the two."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, length: Column) -> Column:
    """Divided by its norm, which is given as a column: within the function it would be computed for every entry. A zero vector stays as it is."""
    return F.transform(a, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def quantised(a: Column) -> Column:
    """To -127 .. 127, halves upwards."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5))).cast("tinyint"))


def restored(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / 127)
