"""Dense-vector Column builders (``array<float|double>``), JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound of the norm product, as in the usual cosine definition that
# maps a zero vector to similarity 0.
COSINE_EPS = 1e-8


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of element products, in double precision, left to right."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    sq = F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(sq)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when either vector is all zeros, NULL for NULL input."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(COSINE_EPS))
