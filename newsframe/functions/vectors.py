"""Vector arithmetic on array<double> columns, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """L2 norm; of a zero vector 1, so that it can be divided by."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Of length 1. The length is the variable of a lambda, so that it is asked once, not again for each component."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / n)), 1)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))
