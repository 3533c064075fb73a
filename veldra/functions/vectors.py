"""Column functions on vectors (array<double>), all inside generated code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v) -> Column:
    """float32 storage, double arithmetic: cast before multiplying."""
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def normalize(v: Column) -> Column:
    """Divided by its length, or by 1e-12 if it is shorter."""
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def peak(v: Column) -> Column:
    """Place (from 1) of the entry of largest size, the first of equals."""
    size = F.transform(v, F.abs)
    return F.array_position(size, F.array_max(size))


def canonical(v: Column) -> Column:
    """The vector or its opposite, so that its largest entry is positive."""
    return F.when(F.element_at(v, peak(v).cast("int")) < 0, F.transform(v, lambda x: -x)).otherwise(v)


def constant(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Kept within bounds; NaN stays NaN, where least() and greatest() alone would lose it."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))
