"""Dense-vector expressions on array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 for the same direction, 2 for the opposite one; null for a zero vector."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Similarity with the small constant the sentence splitter uses against division by zero."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def l2_normalize(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)


def mean_pool(token_vectors: Column) -> Column:
    """Mean of an array of token vectors."""
    count = F.size(token_vectors).cast("double")
    first = F.transform(F.element_at(token_vectors, 1), lambda x: x.cast("double") * F.lit(0.0))
    total = F.aggregate(
        token_vectors, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double"))
    )
    return F.transform(total, lambda x: x / count)


def parse_vector(text: Column) -> Column:
    """'[0.1,0.2]' to array<float>; an empty or malformed text gives an empty array."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\[\]]+|[\s\[\]]+$", "")
    parts = F.transform(F.split(body, r"\s*,\s*"), lambda x: x.try_cast("float"))
    bad = F.exists(parts, lambda x: x.isNull())
    return F.when(bad | (body == ""), F.array().cast("array<float>")).otherwise(parts)
