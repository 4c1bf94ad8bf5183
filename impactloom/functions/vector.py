"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its length; an all-zero one stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(1.0))


def text_vector(text: Column, dimensions: int = 1536) -> Column:
    """A deterministic stand-in for an embedding: code points over 1000 by position, at unit length."""
    at = F.sequence(F.lit(1), F.lit(dimensions))
    return unit(F.transform(at, lambda i: F.when(i <= F.length(text), F.ascii(F.substr(text, i, F.lit(1))) / 1000.0).otherwise(0.0)))
