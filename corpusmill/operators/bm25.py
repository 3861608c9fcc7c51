"""BM25 over a batch of queries.

Layout of the plan, per corpus:

* every document is tokenised once and only tokens some query asks for survive (semi join with the
  query vocabulary), so the shuffle carries matched tokens, not texts;
* those rows are hash-partitioned by document; term frequencies, scores and the per-partition part
  of the top-k are then computed without moving them again;
* document frequency, corpus size and mean length come from the same shuffle (it is reused), via one
  sentinel row per document, so documents without a match still count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.text import tokenize
from corpusmill.session import bounded_broadcast, deal, widen

# No token is empty, so the empty term can stand for "the document itself".
_DOC = ""


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, term, qtf): the query as a bag, so a repeated token weighs twice."""
    tokens = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query))).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _matched(docs: DataFrame, vocabulary: DataFrame, doc_id: str, text: str, scope: list[str]) -> DataFrame:
    wide = widen(docs.select(F.col(doc_id).alias("doc_id"), *scope, F.col(text).alias("_text")), "doc_id")
    tokens = wide.select("doc_id", *scope, tokenize(F.col("_text")).alias("_tokens"))
    rows = tokens.select(
        "doc_id",
        *scope,
        F.size("_tokens").alias("dl"),
        F.explode(F.concat(F.array(F.lit(_DOC)), F.col("_tokens"))).alias("term"),
    )
    # Each row meets every query that has its term: the number of partitions follows from the corpus, not from these narrow rows.
    return deal(rows.join(vocabulary, "term", "left_semi"), "doc_id", docs)


def corpus_statistics(matched: DataFrame, scope: list[str]) -> DataFrame:
    """One row per (scope, term): df, N and mean document length of the scoped corpus."""
    per_doc = matched.groupBy("doc_id", "dl", *scope, "term").agg(F.count(F.lit(1)).alias("tf"))
    by_term = per_doc.groupBy(*scope, "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.col("dl").cast("long")).alias("len_sum")
    )
    # The vocabulary bounds these windows: one row per query term and scope.
    whole = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    total = F.max(F.when(F.col("term") == _DOC, F.col("df"))).over(whole)
    length = F.max(F.when(F.col("term") == _DOC, F.col("len_sum"))).over(whole)
    return by_term.select(
        *scope, "term", "df", total.alias("n_docs"), (length / total).alias("avgdl")
    )


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25_scores(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    query: str = "query",
    scope: list[str] | None = None,
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
    digits: int = 6,
) -> DataFrame:
    """(query_id, doc_id, score) for every document sharing a term with a query.

    ``scope`` names columns (for example the category) that split the corpus into independent
    collections: statistics then differ per scope value, exactly as if each were searched alone.
    Scores are rounded so that ranking does not depend on the order partial sums arrive in.
    """
    scope = scope or []
    terms = query_terms(queries, query_id, query)
    vocabulary = terms.select("term").union(
        queries.select(F.lit(_DOC).alias("term"))
    ).distinct()
    # The vocabulary and the term weights grow with the query batch only (words per query character).
    matched = _matched(docs, bounded_broadcast(vocabulary, queries, 4), doc_id, text, scope)
    stats = corpus_statistics(matched, scope)
    weights = terms.join(stats, "term").select(
        "query_id", *scope, "term", (idf(F.col("n_docs"), F.col("df")) * F.col("qtf")).alias("weight"), "avgdl"
    )
    # No filter on the sentinel here: it would be pushed below the shuffle, which then could not be
    # shared with the statistics. No query has the empty term, so the join drops it anyway.
    tf = matched.groupBy("doc_id", "dl", *scope, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    hit = tf.join(bounded_broadcast(weights, queries, 32 * (64 if scope else 1)), ["term", *scope])
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    part = F.col("weight") * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    scored = hit.groupBy("query_id", "doc_id", "dl", *scope).agg(F.sum(part).alias("_s"))
    return scored.select("query_id", "doc_id", *scope, F.round("_s", digits).alias("score"))


def rank_within(
    scored: DataFrame, k: int, keys: list[str], order: list[Column], rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key; the partial group limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, scope: list[str] | None = None, **kw) -> DataFrame:
    """Best ``k`` documents per query (and scope), ties broken by document id."""
    scored = bm25_scores(docs, queries, scope=scope, **kw)
    return rank_within(scored, k, ["query_id", *(scope or [])], [F.desc("score"), F.asc("doc_id")])


def term_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, cf, idf, n_docs, avgdl) of the whole corpus: the index side of BM25."""
    # Dealt by document, so that terms are counted per document without a further shuffle, in lots of bounded size.
    wide = deal(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id", docs)
    tokens = wide.select("doc_id", tokenize(F.col("_text")).alias("_tokens"))
    totals = docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokenize(F.col(text))).cast("double")).alias("avgdl")
    ).select(F.struct("n_docs", "avgdl").alias("t"))
    postings = tokens.select("doc_id", F.explode("_tokens").alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    by_term = postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )
    one = totals.scalar()["n_docs"], totals.scalar()["avgdl"]
    return by_term.select("term", "df", "cf", idf(one[0], F.col("df")).alias("idf"), one[0].alias("n_docs"), one[1].alias("avgdl"))
