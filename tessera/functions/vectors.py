"""Vector functions: column expressions for single pairs, packed numpy for batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the reference's guard: 0 for empty vectors, 1e-9 added to the product of the norms."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9)))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
