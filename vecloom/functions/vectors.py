"""Vector arithmetic as column expressions. Sums run in double precision, first component first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product; null if a vector or component is null, or the sizes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(F.transform(diff, lambda d: d * d), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: str | Column, zero: str = "keep", eps: float = 1e-12) -> Column:
    """Scales to length 1. A zero vector stays zero; `zero="eps"` divides every vector by its norm + eps instead."""
    n = norm(v)
    by = n + F.lit(eps) if zero == "eps" else F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(v, lambda x: x.cast("double") / by)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 if a vector is zero."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def to_distance(d: str | Column, metric: str = "cosine") -> Column:
    """1 - similarity for cosine; unchanged otherwise."""
    c = F.col(d) if isinstance(d, str) else d
    return F.lit(1.0) - c if metric == "cosine" else c
