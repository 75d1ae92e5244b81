"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, length: Column) -> Column:
    """v over its length (a column of its own, so that it is found once); a zero vector stays as it is."""
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def softmax(v: Column, top: Column) -> Column:
    """exp(x - top) over their sum; top is the largest value."""
    total = lambda powers: F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return let(F.transform(v, lambda x: F.exp(x - top)), lambda powers: let(total(powers), lambda t: F.transform(powers, lambda p: p / t)))


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def arg_max(v: Column) -> Column:
    """Zero-based place of the first largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
