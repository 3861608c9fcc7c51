"""Score normalisation and fusion of two rankings.

A ranking is (query_id, key, score, rank); ``key`` identifies equal texts across branches. Both
branches are already cut to a top-k per query, so every per-query window here is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.operators.bm25 import rank_within


def similarity(distance: Column) -> Column:
    """Distance to similarity; everything at or beyond distance 1 is 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(distance, F.lit(1.0)))


def min_max(branch: DataFrame, is_distance: bool, score: str = "score") -> DataFrame:
    """Add ``norm`` in [0, 1] per query; a branch whose scores are all equal gets 1."""
    w = Window.partitionBy("query_id")
    value = similarity(F.col(score)) if is_distance else F.col(score)
    low, high = F.min("_v").over(w), F.max("_v").over(w)
    return (
        branch.withColumn("_v", F.coalesce(value, F.lit(0.0)))
        .withColumn("_lo", low)
        .withColumn("_hi", high)
        .withColumn(
            "norm",
            F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(
                (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
            ),
        )
        .drop("_v", "_lo", "_hi")
    )


def _branch(df: DataFrame, is_vector: bool, part: Column, shown: Column, extra: list[str]) -> DataFrame:
    """One branch in the common layout; the columns of the other branch are null."""
    none = F.lit(None).cast("double")
    raw = F.col("score").cast("double")
    return df.select(
        "query_id",
        "key",
        part.alias("_part"),
        (shown if is_vector else none).alias("_vec"),
        (none if is_vector else shown).alias("_lex"),
        (raw if is_vector else none).alias("_distance"),
        (none if is_vector else raw).alias("_bm25"),
        F.struct(F.lit(0 if is_vector else 1).alias("b"), F.col("rank").alias("r")).alias("_pos"),
        *extra,
    )


def _merge(vector: DataFrame, lexical: DataFrame, extra: list[str], digits: int) -> DataFrame:
    """Sum the parts per (query, key); a query answered by one branch keeps that branch's own score."""
    fused = (
        vector.unionByName(lexical)
        .groupBy("query_id", "key")
        .agg(
            F.sum("_part").alias("_sum"),
            F.max("_vec").alias("_vec"),
            F.max("_lex").alias("_lex"),
            F.max("_distance").alias("_distance"),
            F.max("_bm25").alias("_bm25"),
            F.min("_pos").alias("_pos"),
            *[F.min_by(c, "_pos").alias(c) for c in extra],
        )
    )
    query = Window.partitionBy("query_id")
    has_vector = F.max(F.col("_distance").isNotNull()).over(query)
    has_lexical = F.max(F.col("_bm25").isNotNull()).over(query)
    marked = fused.withColumn(
        "score_kind",
        F.when(has_vector & has_lexical, "fused").when(has_vector, "distance").otherwise("bm25"),
    )
    own = F.when(F.col("score_kind") == "fused", F.col("_sum")).when(
        F.col("score_kind") == "distance", F.col("_distance")
    ).otherwise(F.col("_bm25"))
    zero = F.lit(0.0)
    return marked.select(
        "query_id",
        "key",
        F.round(own, digits).alias("score"),
        "score_kind",
        F.round(F.coalesce("_vec", zero), digits).alias("vector_score"),
        F.round(F.coalesce("_lex", zero), digits).alias("bm25_score"),
        "_pos",
        *extra,
    )


def fuse_weighted(
    vector: DataFrame,
    lexical: DataFrame,
    vector_weight: float = fixed.VECTOR_WEIGHT,
    bm25_weight: float = fixed.BM25_WEIGHT,
    extra: list[str] | None = None,
    digits: int = 6,
) -> DataFrame:
    """Weighted sum of min-max scores; the weights are scaled to sum to one.

    ``score_kind`` tells which scale a row is on: where only one branch answered a query, its rows
    pass through with their own score (a distance, or a BM25 score).
    """
    extra = extra or []
    total = (vector_weight + bm25_weight) or 1.0
    norm = F.col("norm")
    return _merge(
        _branch(min_max(vector, True), True, norm * F.lit(vector_weight / total), norm, extra),
        _branch(min_max(lexical, False), False, norm * F.lit(bm25_weight / total), norm, extra),
        extra,
        digits,
    )


def fuse_rrf(
    vector: DataFrame, lexical: DataFrame, rrf_k: int = fixed.RRF_K, extra: list[str] | None = None, digits: int = 6
) -> DataFrame:
    """Reciprocal rank fusion; ``vector_score`` and ``bm25_score`` are the raw values."""
    extra = extra or []
    part = F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))
    raw = F.col("score").cast("double")
    return _merge(
        _branch(vector, True, part, raw, extra), _branch(lexical, False, part, raw, extra), extra, digits
    )


def order_fused(fused: DataFrame, k: int) -> DataFrame:
    """Cut to ``k`` per query: best first (a distance is better when small), ties by first position."""
    value = F.when(F.col("score_kind") == "distance", -F.col("score")).otherwise(F.col("score"))
    return rank_within(fused, k, ["query_id"], [F.desc(value), F.asc("_pos"), F.asc("key")])
