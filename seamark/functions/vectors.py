"""Vector Columns: dimensions, normalisation, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions that a truncated embedding may have.
DIMENSIONS = (64, 128, 256, 512, 768)


def snap_dimension(wanted: int, actual: int) -> int:
    """Nearest allowed dimension (ties go up), no more than there are."""
    best = min(DIMENSIONS, key=lambda d: (abs(d - wanted), -d))
    return min(best, actual)


def truncate(v: Column, d: int) -> Column:
    """First d components (all, if there are fewer)."""
    return F.slice(v, 1, d)


def checked(v: Column, d: int) -> Column:
    """v, or an error at run time if it hasn't d components."""
    return F.when(F.size(v) == d, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {d} dimensions, got "), F.size(v).cast("string"))))


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def sum_squares(v: Column) -> Column:
    return F.aggregate(_double(v), F.lit(0.0), lambda a, x: a + x * x)


def normalise(v: Column) -> Column:
    """Unit length, summed in double; a zero vector stays."""
    n = F.sqrt(sum_squares(v))
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    n = F.sqrt(sum_squares(a)) * F.sqrt(sum_squares(b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def euclid(a: Column, b: Column) -> Column:
    """1 / (1 + distance), so that more is nearer as with the others."""
    d = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(d))


METRICS = {"cosine": cosine, "dot": dot, "euclid": euclid}


def similarity(metric: str):
    """The metric's function."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return METRICS[metric]
