"""Batched retrieval over a chunk table: vector branch, lexical branch, fusion, rerank.

The chunk table has ``id`` (long), ``text``, ``category``, ``session_id``, ``filename``,
``embedding`` and ``metadata``; the query table has ``query_id``, ``query`` and, for the vector
branch, ``embedding``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.text import text_key
from corpusmill.operators import fusion, knn
from corpusmill.operators.access import apply_where, resolve_categories
from corpusmill.operators.bm25 import bm25_topk, rank_within
from corpusmill.operators.dedup import dedup_ranked
from corpusmill.session import bounded_broadcast

_CARRIED = ["id", "text", "category", "filename"]


def attach_rows(ranking: DataFrame, chunks: DataFrame, queries: DataFrame, rows_per_query: int) -> DataFrame:
    """Fetch text and origin of ranked ids; the ranking is the small side while the query batch is."""
    small = bounded_broadcast(ranking, queries, max(1.0, rows_per_query / 8.0))
    return chunks.select(*_CARRIED).join(small, "id")


def _empty(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    cols = ", ".join(f"{c} {fields[c]}" for c in _CARRIED)
    return chunks.sparkSession.createDataFrame(
        [], f"{cols}, query_id {queries.schema['query_id'].dataType.simpleString()}, score double, rank int"
    )


def _rerank_positions(df: DataFrame, order: list, k: int) -> DataFrame:
    return rank_within(df.withColumnRenamed("rank", "_r"), k, ["query_id"], order).drop("_r")


def vector_search(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = fixed.RETRIEVE_TOP_K,
    category: str | None = None,
    allowed: list[str] | None = None,
    session_id: str | None = None,
    dedup: bool = True,
    parity: bool = False,
) -> DataFrame:
    """Nearest chunks per query; ``score`` is the cosine distance.

    Uploads of a session come first and are visible to that session only. Uploads of other sessions
    are removed before the cut; with ``parity`` they are removed after it (so they can crowd out
    results), and the category list also applies to the caller's own uploads.
    """
    granted, filt = resolve_categories(category, allowed, parity)
    if not granted:
        return _empty(chunks, queries)
    fetch = top_k * 2 if dedup else top_k
    where = {"category": filt} if filt is not None else None
    shared = F.col("session_id").isNull() | (F.col("session_id") == "")
    scoped = apply_where(chunks, where)
    found = knn.knn(scoped if parity else scoped.where(shared), queries, fetch, vec_id="id")
    if parity:
        own = chunks.where(~shared).select(F.col("id").alias("vec_id"))
        found = found.join(own, "vec_id", "left_anti")
    branches = found.withColumn("_branch", F.lit(1))
    if session_id:
        mine = (scoped if parity else chunks).where(F.col("session_id") == session_id)
        branches = knn.knn(mine, queries, fetch, vec_id="id").withColumn("_branch", F.lit(0)).unionByName(branches)
    ranked = rank_within(
        branches.withColumnRenamed("rank", "_r"), fetch * 2, ["query_id"], [F.asc("_branch"), F.asc("_r")]
    ).select("query_id", F.col("vec_id").alias("id"), F.col("distance").alias("score"), "rank")
    rows = attach_rows(ranked, chunks, queries, fetch * 2)
    if dedup:
        rows = dedup_ranked(rows, ["query_id"], ["rank"])
    elif session_id:
        head = rows.withColumn("_h", F.substring("text", 1, 200))
        first = head.groupBy("query_id", "_h").agg(F.min("rank").alias("rank")).select("query_id", "rank")
        rows = rows.join(first, ["query_id", "rank"], "left_semi")
    return _rerank_positions(rows, [F.asc("_r")], top_k)


def lexical_search(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = 10,
    category: str | None = None,
    allowed: list[str] | None = None,
    dedup: bool = True,
    parity: bool = False,
) -> DataFrame:
    """BM25 ranking of corpus chunks (never uploads); statistics are those of the filtered corpus."""
    granted, filt = resolve_categories(category, allowed, parity)
    if not granted:
        return _empty(chunks, queries)
    corpus = chunks.where(F.col("session_id").isNull() | (F.col("session_id") == ""))
    corpus = apply_where(corpus, {"category": filt} if filt is not None else None)
    ranked = bm25_topk(corpus, queries, k=top_k * 2, doc_id="id").select(
        "query_id", F.col("doc_id").alias("id"), "score", "rank"
    ).where(F.col("score") > 0)
    rows = attach_rows(ranked, chunks, queries, top_k * 2)
    if dedup:
        rows = dedup_ranked(rows, ["query_id"], ["rank"])
    return _rerank_positions(rows, [F.asc("_r")], top_k)


def fuse(
    vector: DataFrame, lexical: DataFrame, top_k: int, method: str = "weighted", dedup: bool = True, **weights
) -> DataFrame:
    """Merge two branch results by normalised text, cut, remove near duplicates, cut again."""
    keyed = [b.withColumn("key", text_key(F.col("text"))) for b in (vector, lexical)]
    merge = fusion.fuse_rrf if method == "rrf" else fusion.fuse_weighted
    fused = merge(*keyed, extra=_CARRIED, **weights)
    cut = fusion.order_fused(fused, top_k * 2).drop("_pos")
    if dedup:
        cut = dedup_ranked(cut, ["query_id"], ["rank"])
    return _rerank_positions(cut, [F.asc("_r")], top_k)


def hybrid_search(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = 3,
    category: str | None = None,
    allowed: list[str] | None = None,
    session_id: str | None = None,
    vector_k: int | None = None,
    bm25_k: int | None = None,
    method: str = "weighted",
    hybrid: bool = True,
    dedup: bool = True,
    parity: bool = False,
    **weights,
) -> DataFrame:
    """Vector and BM25 branches fused; with ``hybrid=False`` the vector branch alone."""
    if not resolve_categories(category, allowed, parity)[0]:
        return _empty(chunks, queries)
    common = {"category": category, "allowed": allowed, "dedup": dedup, "parity": parity}
    if not hybrid:
        return vector_search(chunks, queries, top_k, session_id=session_id, **common)
    return fuse(
        vector_search(chunks, queries, vector_k or top_k * 5, session_id=session_id, **common),
        lexical_search(chunks, queries, bm25_k or top_k * 5, **common),
        top_k,
        method,
        dedup,
        **weights,
    )


def pin_rows(
    results: DataFrame, queries: DataFrame, chunks: DataFrame, rules: list[tuple[str, list[str]]],
    allowed: list[str] | None = None,
) -> DataFrame:
    """Put a known chunk first for queries on a known subject, when the results lack it.

    Each rule is (query pattern, phrases the chunk must hold, the first of which marks it as present).
    The first matching chunk by id is used, if its category may be seen.
    """
    visible = chunks
    if allowed and "*" not in allowed:
        visible = chunks.where(F.col("category").isin(allowed))
    out = results
    for pattern, phrases in rules:
        test = F.lit(True)
        for phrase in phrases:
            test = test & F.col("text").contains(phrase)
        pinned = visible.where(test).orderBy("id").limit(1).select(*_CARRIED)
        present = out.where(F.col("text").contains(phrases[0])).select("query_id").distinct()
        wanted = queries.where(F.lower("query").rlike(pattern)).select("query_id")
        missing = wanted.join(present, "query_id", "left_anti").withColumn("_one", F.lit(1))
        extra = missing.join(pinned.withColumn("_one", F.lit(1)), "_one").drop("_one")
        extra = extra.withColumn("score", F.lit(1.0)).withColumn("rank", F.lit(0))
        out = out.unionByName(extra, allowMissingColumns=True)
    return _rerank_positions(out, [F.asc("_r")], 2**31 - 1)
