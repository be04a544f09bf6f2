"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is null or all zeros."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def score(cos: Column, mode: str = "cosine") -> Column:
    """A retrieval score between 0 and 1. ``reference`` is the distance 1 - cos, by which the nearest scores lowest; ``cosine`` the similarity."""
    if mode not in ("cosine", "reference"):
        raise ValueError(mode)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cos if mode == "reference" else cos))
