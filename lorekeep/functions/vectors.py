"""Vector expressions: float32 at rest, double in arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    """The sum of products over the shorter length, in order."""
    x, y = doubles(a), doubles(b)
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def normalized(v: str | Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    x = doubles(v)
    squares = F.aggregate(x, F.lit(0.0), lambda s, p: s + p * p)
    return F.when(squares <= 0, x).otherwise(F.transform(x, lambda p: p * (1 / F.sqrt(squares))))


def cosine_from_distance(distance: str | Column) -> Column:
    """The cosine of unit vectors at a Euclidean distance."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return 1 - d * d / 2


def rounded(x: str | Column, digits: int) -> Column:
    """`round` that keeps the sign of what becomes zero, as a double's -0.0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(F.abs(x), digits) * F.signum(x)
