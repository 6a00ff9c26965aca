"""Vector arithmetic as column expressions: evaluated in the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def dot(a: Column, b: Column) -> Column:
    """Dot product; null if either is null or lengths differ in a way that pairs a number with nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_of_distance(d: Column) -> Column:
    """Cosine of unit vectors at distance d, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d * d / 2))


def unit(a: Column) -> Column:
    """The vector at length 1; unchanged where it has none."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def has_shape(a: Column, dim: int) -> Column:
    """Whether a is a vector of `dim` numbers, none null, NaN or infinite."""
    return a.isNotNull() & (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
