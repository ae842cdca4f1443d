"""Vector and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def scaled(df: DataFrame, column: str) -> Column:
    """Column of ``df`` scaled to 0 to 1 over all rows, whose least and greatest values are found first."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return (F.col(column) - F.lit(low)) / (F.lit(high) - F.lit(low) + EPSILON)


def min_max(c: Column) -> Column:
    """Scores of a top-k list scaled to 0 to 1, all of them in one task; ``scaled`` is for whole tables."""
    w = Window.partitionBy()
    return (c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + EPSILON)


def synonym_weight(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.7), similarity * 0.7))


def hint_boost(weight: Column) -> Column:
    return F.least(F.lit(0.25), F.lit(0.05) + weight * 0.02)
