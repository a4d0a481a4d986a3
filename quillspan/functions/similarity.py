"""Similarity of vectors and of token arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 if either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def _share(common: Column, of: Column) -> Column:
    return F.when(of > 0, common / of).otherwise(F.lit(0.0))


def overlap_smaller(a: Column, b: Column) -> Column:
    """Common tokens over the smaller set; 0 if one is empty."""
    return _share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def overlap_gold(gold: Column, chunk: Column) -> Column:
    """Common tokens over the gold set; 0 if that is empty."""
    return _share(F.size(F.array_intersect(gold, chunk)), F.size(gold))


def rank_term(rank: Column, weight: Column | float = 1.0, c: int = 60) -> Column:
    """One list's part of a reciprocal-rank fusion; ranks start at 0."""
    return (F.lit(weight) if isinstance(weight, (int, float)) else weight) / (F.lit(float(c)) + rank + 1)
