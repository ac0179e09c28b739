"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Similarity, that is 1 minus the cosine distance; null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(a: Column) -> Column:
    """Unit vector in double; null for a zero, infinite or NaN norm."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def valid(a: Column, dimension: int, unit: bool = True) -> Column:
    """Whether a has this many components, all finite, and (unit) a norm within 1e-4 of 1."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size(a) == dimension) & finite
    return F.coalesce(good & (F.abs(norm(a) - 1) <= 1e-4) if unit else good, F.lit(False))
