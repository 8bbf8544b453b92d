"""Column expressions on array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each cosine definition adds to the product of the norms.
VIEWER, SAMPLE_V1, SAMPLE_V3 = "viewer", "sample_v1", "sample_v3"
COSINE_EPSILON = {VIEWER: 1e-9, SAMPLE_V1: 1e-12, SAMPLE_V3: 1e-12}


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(vector: Column, zero_as_one: bool = False) -> Column:
    """Euclidean norm; with `zero_as_one` a zero vector reports 1.0, as sample_v3 wants."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, norm).otherwise(F.lit(1.0)) if zero_as_one else norm


def cosine_from(product: Column, norm_a: Column, norm_b: Column, mode: str = VIEWER) -> Column:
    """Cosine from a dot product and two plain norms; a zero vector always scores 0.0."""
    epsilon = COSINE_EPSILON[mode]
    if mode == SAMPLE_V3:
        norm_a = F.when(norm_a > 0, norm_a).otherwise(F.lit(1.0))
        norm_b = F.when(norm_b > 0, norm_b).otherwise(F.lit(1.0))
    score = product / (norm_a * norm_b + F.lit(epsilon))
    if mode == VIEWER:
        return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(score)
    return score


def cosine(a: Column, b: Column, mode: str = VIEWER) -> Column:
    return cosine_from(dot(a, b), l2_norm(a), l2_norm(b), mode)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(vector: Column) -> Column:
    """Divide by the norm; a zero vector stays zero."""
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)
