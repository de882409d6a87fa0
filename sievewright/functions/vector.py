"""Vectors as array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(a: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def normalized(a: Column) -> Column:
    """The vector scaled to length 1; null for a zero vector and one with non-finite components."""
    n = norm(a)
    return F.when(finite(a) & (n > 0), F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; null if either vector is zero."""
    bottom = norm(a) * norm(b)
    return F.when(bottom > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / bottom)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def kl_divergence(p: Column, q: Column, least: float = 1e-12) -> Column:
    """Sum of p * ln(p / q) over components where p is positive."""
    parts = F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / F.greatest(y, F.lit(least)))).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
