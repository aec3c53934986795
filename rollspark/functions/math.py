"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def miss_all(n: Column, c: Column, k: int) -> Column:
    """C(n-c, k) / C(n, k): the chance that k draws without replacement out of n miss all c; 0 when fewer than k are left."""
    terms = F.sequence(F.lit(0), F.lit(k - 1))
    product = F.aggregate(terms, F.lit(1.0), lambda acc, i: acc * (n - c - i).cast("double") / (n - i))
    return F.when(n - c < k, F.lit(0.0)).otherwise(product)


def round6(c: Column) -> Column:
    return F.round(c, 6)


def entropy_bits(counts: Column) -> Column:
    """Entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))
