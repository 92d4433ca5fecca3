"""Column functions for arrays of doubles; all of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Machine epsilon of doubles, added to norms before a division.
EPS = 2.220446049250313e-16


def as_doubles(vector: Column) -> Column:
    """Doubles throughout, with null components as NaN (an unobserved coordinate)."""
    return F.transform(vector.cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """a / (norm + machine epsilon), so that a zero vector stays zero.

    The norm stands outside the lambda, which would compute it again for each component.
    """
    return F.zip_with(a, F.array_repeat(norm2(a) + EPS, F.size(a)), lambda v, n: v / n)


def soft_threshold(x: Column, eta: Column | float) -> Column:
    """sign(x) * max(|x| - eta, 0); also the shrinkage of the tracker and the prox of the plain L1 norm."""
    e = F.lit(eta) if isinstance(eta, int | float) else eta
    return F.signum(x) * F.greatest(F.abs(x) - e, F.lit(0.0))


def step_sigmoid(x: Column) -> Column:
    """The tracker's step rule: an odd sigmoid with limits -1 and 1, equal to tanh(5 x)."""
    return F.tanh(F.lit(5.0) * x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up at so many digits, the same in every engine (floor, unlike round, has no ties to break)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def literal_vector(values) -> Column:
    """A constant array of doubles; for vectors of a model's width, not for data."""
    if not all(math.isfinite(v) for v in values):
        raise ValueError("a literal vector needs finite values")
    return F.array(*[F.lit(float(v)) for v in values])
