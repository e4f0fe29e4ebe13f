"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where lengths differ."""
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(F.size(x) == F.size(y), F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot(x, y), norms)))


def simplex(vector: Column) -> Column:
    """Squares over their sum: a stand-in for a topic distribution."""
    squares = F.transform(doubles(vector), lambda v: v * v)
    total = F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)
    return F.transform(squares, lambda v: F.try_divide(v, total))


def largest(vector: Column, n: int) -> Column:
    """(weight, topic) structs of the ``n`` largest components, the smaller topic first among equals."""
    placed = F.transform(vector, lambda v, i: F.struct((-v).alias("less"), i.alias("topic")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda s: F.struct((-s["less"]).alias("weight"), s["topic"].alias("topic")))


def chi_square(both: Column, first: Column, second: Column, total: Column, correction: str = "signed") -> Column:
    """Chi-square of a pair with continuity correction, in doubles; null where a margin is empty.

    ``signed`` subtracts half the total from the signed difference, ``yates`` from its absolute value.
    """
    yy, yb, ya, t = (c.cast("double") for c in (both, first, second, total))
    nb, na, yn, ny = t - yb, t - ya, ya - yy, yb - yy
    difference = yy * (t - ny - yn - yy) - yn * ny
    inner = (difference if correction == "signed" else F.abs(difference)) - t / 2
    return F.try_divide(t * inner * inner, ya * na * yb * nb)
