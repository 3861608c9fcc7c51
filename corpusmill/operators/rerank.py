"""Reranking: an external relevance score plus lexical adjustments, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.text import WORD, strip
from corpusmill.operators.bm25 import rank_within
from corpusmill.operators.dedup import dedup_ranked


def lexical_boost(query: Column, text: Column) -> Column:
    """Adjustment for negation, article numbers and long query words found in the text."""
    q, t = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))

    def both(a: str, b: str) -> Column:
        return q.contains(a) & t.contains(b)

    negation = (
        F.when(both("không thuộc", "không thuộc"), 1.5)
        .when(both("không thuộc", "không học"), 1.2)
        .when(both("không", "không"), 0.5)
        .otherwise(0.0)
    )
    contradiction = F.when(
        q.contains("không thuộc") & ~t.contains("không thuộc") & t.contains("thuộc chuyên"), -0.8
    ).otherwise(0.0)
    numbers = F.regexp_extract_all(q, F.lit(r"điều\s*(\d+)"), F.lit(1))
    named = F.exists(numbers, lambda n: t.contains(F.concat(F.lit("điều "), n)))
    article = (
        F.when(F.size(numbers) == 0, 0.0).when(named, 2.0).when(t.contains("điều"), -0.6).otherwise(0.0)
    )
    words = F.filter(F.split(q, rf"[^{WORD}]+"), lambda w: F.length(w) > 4)
    found = F.size(F.filter(F.slice(words, 1, 3), lambda w: t.contains(w)))
    return negation + contradiction + article + found * F.lit(0.3)


def rerank(
    ranked: DataFrame,
    base: Column,
    k: int = fixed.RERANK_TOP_K,
    boost: bool = True,
    dedup: bool = True,
    digits: int = 6,
) -> DataFrame:
    """Reorder each query's ranked list by ``base`` (a model score column) plus the lexical boost.

    ``ranked`` has query_id, query, text and rank and is already a bounded top-k per query. Texts
    shorter than five characters are not scored; if a query has no other text, its list is returned
    in the old order. Near duplicates are removed after sorting and the list is not refilled.
    """
    usable = F.length(strip(F.coalesce(F.col("text"), F.lit("")))) >= 5
    score = base.cast("double")
    if boost:
        score = score + lexical_boost(F.col("query"), F.col("text"))
    marked = ranked.withColumn("_ok", usable).withColumn("_old", F.col("rank")).drop("rank")
    state = marked.groupBy("query_id").agg(F.max("_ok").alias("_any"))
    joined = marked.join(state, "query_id").where(F.col("_ok") | ~F.col("_any"))
    scored = joined.withColumn("rerank_score", F.when(F.col("_ok"), F.round(score, digits)))
    wide = rank_within(
        scored, 2**31 - 1, ["query_id"], [F.desc_nulls_last("rerank_score"), F.asc("_old")]
    ).drop("_ok", "_any", "_old")
    if dedup:
        wide = dedup_ranked(wide, ["query_id"], ["rank"])
    return rank_within(wide.withColumnRenamed("rank", "_r"), k, ["query_id"], [F.asc("_r")]).drop("_r")


def fetch_size(top_k: int | None, use_rerank: bool) -> int:
    """How many documents to fetch before reranking."""
    k = top_k if top_k is not None else (fixed.RERANK_TOP_K if use_rerank else fixed.RETRIEVE_TOP_K)
    return min(max(1, k) * 5, 15) if use_rerank else max(1, k)
