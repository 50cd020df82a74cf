"""Scores of search hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(value: Column) -> Column:
    """The value, limited to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def score_from_distance(value: Column, metric: str = "cosine_distance", normalize: bool = True, alpha: float = 1.0) -> Column:
    """A score that rises with similarity, from what an index of ``metric`` returns."""
    made = {
        "cosine_distance": lambda v: 1 - v / 2,
        "cosine_similarity": lambda v: (v + 1) / 2,
        "l2": lambda v: F.exp(-v * alpha),
        "inner_product": lambda v: v,
    }.get(metric, lambda v: 1 - v)(value)
    return clamp01(made) if normalize else made


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, as double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length == 0, vector.cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / length))
