"""Vector arithmetic on arrays of floats, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(v: Column) -> Column:
    """The vector with components that are no finite number made 0."""
    zero = F.lit(0.0)
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), zero).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where the lengths differ or a vector is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1 - dot(a, b) / norm)


def check_dim(v: Column, dim: int) -> Column:
    """The vector, or an error where it has another length."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} components, got "), F.size(v).cast("string"))))
