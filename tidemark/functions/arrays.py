"""Arrays and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_from_zero(value: Column, start: int, end: int | None = None) -> Column:
    """Elements from a 0-based start up to, not including, the end."""
    size = F.size(value)
    stop = size if end is None else F.least(F.lit(end), size)
    return F.slice(value, F.lit(start + 1), F.greatest(stop - start, F.lit(0)))


def length(value: Column) -> Column:
    """Number of elements; null has none."""
    return F.when(value.isNull(), 0).otherwise(F.size(value))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in the order of the elements."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of unequal length or norm zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def semantic_match(a: Column, b: Column, least: float = 0.7) -> Column:
    return cosine(a, b) > least
