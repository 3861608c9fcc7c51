"""Retrieval queries: ranking, fusion, access control."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import access, bm25, fusion, knn, pivotknn, postings, rerank
from corpusmill.functions.text import text_key
from corpusmill.plans import retrieval
from corpusmill.plans.indexes import lexical_index, vector_index
from corpusmill.plans.tables import documents, questions, table, vectors
from corpusmill.session import bounded_broadcast


def lexical_topk(spark, folder, k):
    """The best ``k`` documents of each question, from the stored index."""
    return postings.search(spark, lexical_index(spark, documents(spark, folder)), questions(spark, folder), k)


def bm25_topk(spark, folder):
    return _long_rank(lexical_topk(spark, folder, 5))


def bm25_category(spark, folder):
    index = lexical_index(spark, documents(spark, folder), ["source"])
    found = postings.search(spark, index, questions(spark, folder), 3, ["source"])
    return _long_rank(found.withColumnRenamed("source", "category"))


def bm25_scan(spark, folder):
    """Without an index, as for a corpus that is a filter's result: texts are tokenised and scored as they are read."""
    return _long_rank(bm25.bm25_topk(documents(spark, folder), questions(spark, folder), k=5)).select("query_id", "doc_id", "score", "rank")


def tokenize_stats(spark, folder):
    return bm25.term_statistics(documents(spark, folder)).select(
        "term", "df", "cf", F.round("idf", 6).alias("idf"), "n_docs", F.round("avgdl", 6).alias("avgdl")
    )


def centroids(spark, folder):
    """One query vector per label: the rounded mean of its vectors."""
    part = vectors(spark, folder).select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = part.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return mean.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(ordered, lambda s: s["x"]).alias("embedding")
    )


def _chunks(spark, folder):
    """Documents as a chunk table, with the vector of the same number where there is one."""
    vec = vectors(spark, folder).select(F.col("vec_id").alias("id"), "embedding")
    docs = documents(spark, folder).select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("source").alias("category"),
        F.concat(F.col("lang"), F.lit("/"), F.col("source")).alias("filename"),
        F.lit(None).cast("string").alias("session_id"),
    )
    return docs.join(vec, "id", "left")


def _vector_questions(spark, folder):
    vec = vectors(spark, folder).select(F.col("vec_id").alias("query_id"), "embedding")
    return questions(spark, folder).join(vec, "query_id")


def _long_rank(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


def knn_topk(spark, folder):
    return _long_rank(knn.knn(vectors(spark, folder), centroids(spark, folder), 10))


def knn_replicated(spark, folder):
    """``knn_topk`` by the join of fragments with blocks that batches beyond the broadcast bound take."""
    return _long_rank(knn.knn(vectors(spark, folder), centroids(spark, folder), 10, max_floats=1, fragment_rows=500, block_rows=4))


def knn_pivots(spark, folder):
    """``knn_topk`` over a stored index of pivots."""
    index = vector_index(spark, vectors(spark, folder))
    return _long_rank(pivotknn.search(spark, index, centroids(spark, folder), 10)[0])


def knn_filtered(spark, folder):
    rows = vectors(spark, folder).select(
        "vec_id",
        "embedding",
        F.col("label").cast("string").alias("category"),
        F.to_json(F.struct((F.col("vec_id") % 2).cast("string").alias("side"))).alias("metadata"),
    )
    where = {"$and": [{"category": ["1", "3", "4"]}, {"side": "1"}]}
    return _long_rank(knn.knn(access.apply_where(rows, where), centroids(spark, folder), 5))


def minmax_norm(spark, folder):
    near = knn.knn(vectors(spark, folder), centroids(spark, folder), 20).withColumnRenamed("distance", "score")
    return fusion.min_max(near, is_distance=True).select(
        "query_id", "vec_id", "score", F.round("norm", 6).alias("norm")
    )


def _branches(spark, folder, k):
    docs = documents(spark, folder).select(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"))
    asked = _vector_questions(spark, folder)
    near = knn.knn(_chunks(spark, folder).where(F.col("embedding").isNotNull()), asked, k, vec_id="id").select(
        "query_id", F.col("vec_id").alias("id"), F.col("distance").alias("score"), "rank"
    )
    lexical = lexical_topk(spark, folder, k).select(
        "query_id", F.col("doc_id").alias("id"), "score", "rank"
    )
    # k rows for each question at most.
    return [docs.join(bounded_broadcast(b, asked, k), "id") for b in (near, lexical)]


def _fused(merge):
    def run(spark, folder):
        fused = merge(*_branches(spark, folder, 15), extra=["id"])
        return _long_rank(fusion.order_fused(fused, 5)).drop("_pos")

    return run


def _search(spark, folder, **kw):
    out = retrieval.hybrid_search(_chunks(spark, folder), _vector_questions(spark, folder), **kw)
    return _long_rank(out).select("query_id", "rank", "id", "score", "score_kind")


def hybrid_weighted(spark, folder):
    return _search(spark, folder, top_k=5)


def hybrid_rrf(spark, folder):
    return _search(spark, folder, top_k=5, method="rrf")


def hybrid_allowed(spark, folder):
    return _search(spark, folder, top_k=3, allowed=["src1", "src2", "src3"])


def rerank_boost(spark, folder):
    ranked = lexical_topk(spark, folder, 10)
    texts = documents(spark, folder).select("doc_id", "text").join(bounded_broadcast(ranked, questions(spark, folder), 10), "doc_id")
    pairs = texts.join(bounded_broadcast(*[questions(spark, folder)] * 2), "query_id")
    return pairs.select(
        "query_id", "doc_id", F.round(rerank.lexical_boost(F.col("query"), F.col("text")), 6).alias("boost")
    )


def rerank_topk(spark, folder):
    """Rerank the hybrid top 15 with the fused score standing in for the model score."""
    asked = _vector_questions(spark, folder)
    found = retrieval.hybrid_search(_chunks(spark, folder), asked, top_k=15)
    pairs = found.join(bounded_broadcast(asked.select("query_id", "query"), asked), "query_id")
    out = rerank.rerank(pairs, F.col("score"), k=4)
    return _long_rank(out).select("query_id", "rank", "id", "rerank_score")


def acl_filter(spark, folder):
    """Documents each user may see: allow-lists derived from the categories the user's events touch."""
    users = table(spark, folder, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("src"), F.col("event_id") % 7))).alias("all_cats"),
        F.count(F.lit(1)).alias("n"),
    )
    users = users.select(
        "user_id",
        F.when(F.col("user_id") % 10 == 0, F.array(F.lit("*")))
        .when(F.col("user_id") % 10 == 1, F.array().cast("array<string>"))
        .otherwise(F.slice("all_cats", 1, 3)).alias("categories"),
    )
    counts = documents(spark, folder).groupBy(F.col("source").alias("category")).agg(
        F.count(F.lit(1)).alias("docs")
    )
    listed = users.withColumn("allowed", access.allowed_categories(F.col("categories")))
    limited = listed.where(F.col("allowed").isNotNull()).select("user_id", F.explode("allowed").alias("category"))
    granted = limited.join(counts, "category").groupBy("user_id").agg(F.sum("docs").alias("visible"))
    total = counts.agg(F.sum("docs").alias("n")).scalar()
    return listed.join(granted, "user_id", "left").select(
        "user_id",
        F.when(F.col("allowed").isNull(), total).otherwise(F.coalesce("visible", F.lit(0))).cast("long").alias("visible"),
        F.col("allowed").isNull().alias("unrestricted"),
    )


def fill(template: str, **parts: str) -> str:
    """Replace <name> markers in a SQL text."""
    for name, value in parts.items():
        template = template.replace(f"<{name}>", value)
    return template


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)"

# Shared SQL: postings, per-scope statistics, scores; <scope> is a column list with a trailing comma.
BM25_SQL = """
WITH doc AS (SELECT doc_id, <select> """ + TOKENS + """ AS toks FROM documents),
tok AS (SELECT doc_id, <scope> unnest(toks) AS term FROM doc),
tf AS (SELECT doc_id, <scope> term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT <scope> count(*) AS n_docs, avg(len(toks)) AS avgdl FROM doc <group>),
df AS (SELECT <scope> term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT item_id AS query_id, unnest(""" + TOKENS + """) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
dl AS (SELECT doc_id, len(toks) AS dl FROM doc),
sc AS (
  SELECT query_id, tf.doc_id, <tfscope>
    round(sum(qtf * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE
      / (tf + 1.5::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df <dfjoin> JOIN n <njoin> JOIN dl ON dl.doc_id = tf.doc_id
  GROUP BY ALL)
"""
BM25_GLOBAL = fill(BM25_SQL, select="", scope="", group="", tfscope="", dfjoin="ON df.term = qt.term", njoin="ON true")
BM25_BY_CATEGORY = fill(BM25_SQL, 
    select="source AS category,", scope="category,", group="GROUP BY ALL", tfscope="tf.category AS category,",
    dfjoin="ON df.term = qt.term AND df.category = tf.category", njoin="ON n.category = tf.category",
)

CENTROID_SQL = """
cen AS (SELECT label::BIGINT AS query_id, pos, round(avg(x::DOUBLE), 6) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
qv AS (SELECT query_id, list(x ORDER BY pos) AS qe FROM cen GROUP BY query_id)"""
DISTANCE = """round(1 - list_dot_product(embedding::DOUBLE[], qe::DOUBLE[])
  / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[]))), 6)"""
KNN_SQL = "WITH" + CENTROID_SQL + """,
d AS (SELECT query_id, vec_id, """ + DISTANCE + """ AS distance FROM embeddings, qv <where>)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
FROM d QUALIFY rank <= <n>"""
KEY = "md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')))"
BRANCH_SQL = BM25_GLOBAL + """,
qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings ON item_id = vec_id),
dv AS (SELECT query_id, vec_id AS id, """ + DISTANCE + """ AS score FROM embeddings JOIN documents ON vec_id = doc_id, qv),
vec AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank
  FROM dv QUALIFY rank <= 15),
lex AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM sc QUALIFY rank <= 15),
keys AS (SELECT doc_id AS id, """ + KEY + """ AS key FROM documents),
b AS (
  SELECT query_id, id, key, score, rank, 0 AS br, greatest(0, 1 - least(score, 1)) AS v FROM vec JOIN keys USING (id)
  UNION ALL SELECT query_id, id, key, score, rank, 1 AS br, score AS v FROM lex JOIN keys USING (id)),
nb AS (SELECT *, CASE WHEN max(v) OVER w = min(v) OVER w THEN 1.0::DOUBLE
    ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS norm
  FROM b WINDOW w AS (PARTITION BY query_id, br)),
pos AS (SELECT *, br * 1000000 + rank AS p, max(br) OVER (PARTITION BY query_id) AS hi, min(br) OVER (PARTITION BY query_id) AS lo FROM nb),
f AS (SELECT query_id, key, arg_min(id, p) AS id, min(p) AS p, any_value(hi) AS hi, any_value(lo) AS lo,
    round(sum(<part>), 6) AS fused, round(max(score) FILTER (br = 0), 6) AS vraw, round(max(score) FILTER (br = 1), 6) AS braw,
    round(coalesce(max(<shown>) FILTER (br = 0), 0), 6) AS vector_score,
    round(coalesce(max(<shown>) FILTER (br = 1), 0), 6) AS bm25_score
  FROM pos GROUP BY query_id, key),
g AS (SELECT *, CASE WHEN hi <> lo THEN 'fused' WHEN hi = 0 THEN 'distance' ELSE 'bm25' END AS score_kind,
    CASE WHEN hi <> lo THEN fused WHEN hi = 0 THEN vraw ELSE braw END AS score FROM f)
SELECT query_id, key, id, score, score_kind, vector_score, bm25_score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score_kind = 'distance' THEN -score ELSE score END DESC, p, key) AS rank
FROM g QUALIFY rank <= 5"""

QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_category": bm25_category,
    "bm25_scan": bm25_scan,
    "tokenize_stats": tokenize_stats,
    "knn_topk": knn_topk,
    "knn_pivots": knn_pivots,
    "knn_replicated": knn_replicated,
    "knn_filtered": knn_filtered,
    "minmax_norm": minmax_norm,
    "fuse_weighted": _fused(fusion.fuse_weighted),
    "fuse_rrf": _fused(fusion.fuse_rrf),
    "hybrid_weighted": hybrid_weighted,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_allowed": hybrid_allowed,
    "rerank_boost": rerank_boost,
    "rerank_topk": rerank_topk,
    "acl_filter": acl_filter,
}
BM25_TOP = BM25_GLOBAL + """
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM sc QUALIFY rank <= 5"""

ORACLES = {
    "bm25_topk": BM25_TOP,
    "bm25_scan": BM25_TOP,
    "bm25_category": BM25_BY_CATEGORY + """
SELECT query_id, category, doc_id, score,
  row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, doc_id) AS rank
FROM sc QUALIFY rank <= 3""",
    "tokenize_stats": """
WITH doc AS (SELECT doc_id, """ + TOKENS + """ AS toks FROM documents),
tok AS (SELECT doc_id, unnest(toks) AS term FROM doc),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM doc)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf,
  round(ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1.0::DOUBLE), 6) AS idf,
  any_value(n_docs) AS n_docs, round(any_value(avgdl), 6) AS avgdl
FROM tf, n GROUP BY term""",
    "knn_topk": fill(KNN_SQL, where="", n="10"),
    "knn_pivots": fill(KNN_SQL, where="", n="10"),
    "knn_replicated": fill(KNN_SQL, where="", n="10"),
    "knn_filtered": fill(KNN_SQL, where="WHERE label IN (1, 3, 4) AND vec_id % 2 = 1", n="5"),
    "minmax_norm": "WITH" + CENTROID_SQL + """,
d AS (SELECT query_id, vec_id, """ + DISTANCE + """ AS score FROM embeddings, qv),
t AS (SELECT *, greatest(0, 1 - least(score, 1)) AS v FROM d
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 20)
SELECT query_id, vec_id, score, round(CASE WHEN max(v) OVER w = min(v) OVER w THEN 1
  ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END, 6) AS norm
FROM t WINDOW w AS (PARTITION BY query_id)""",
    "fuse_weighted": fill(BRANCH_SQL, part="norm * CASE br WHEN 0 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END", shown="norm"),
    "fuse_rrf": fill(BRANCH_SQL, part="1.0::DOUBLE / (60 + rank)", shown="score"),
    "rerank_boost": BM25_GLOBAL + """,
top AS (SELECT query_id, doc_id FROM sc
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
p AS (SELECT query_id, top.doc_id, lower(b.text) AS q, lower(d.text) AS t
  FROM top JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
w AS (SELECT *, list_filter(regexp_split_to_array(q, '[^\\p{L}\\p{N}_]+'), lambda x: length(x) > 4)[1:3] AS words,
  regexp_extract_all(q, 'điều\\s*(\\d+)', 1) AS nums FROM p)
SELECT query_id, doc_id, round(
    CASE WHEN contains(q, 'không thuộc') AND contains(t, 'không thuộc') THEN 1.5::DOUBLE
         WHEN contains(q, 'không thuộc') AND contains(t, 'không học') THEN 1.2
         WHEN contains(q, 'không') AND contains(t, 'không') THEN 0.5 ELSE 0 END
  + CASE WHEN contains(q, 'không thuộc') AND NOT contains(t, 'không thuộc') AND contains(t, 'thuộc chuyên')
         THEN -0.8::DOUBLE ELSE 0 END
  + CASE WHEN len(nums) = 0 THEN 0::DOUBLE
         WHEN len(list_filter(nums, lambda n: contains(t, 'điều ' || n))) > 0 THEN 2.0
         WHEN contains(t, 'điều') THEN -0.6 ELSE 0 END
  + 0.3::DOUBLE * len(list_filter(words, lambda x: contains(t, x))), 6) AS boost
FROM w""",
    "acl_filter": """
WITH u AS (SELECT user_id, list_sort(list(DISTINCT 'src' || (event_id % 7))) AS cats FROM events GROUP BY user_id),
l AS (SELECT user_id, CASE user_id % 10 WHEN 0 THEN ['*'] WHEN 1 THEN [] ELSE cats[1:3] END AS c FROM u),
r AS (SELECT user_id, c, len(c) = 0 OR list_contains(c, '*') AS unrestricted FROM l)
SELECT user_id, CASE WHEN unrestricted THEN (SELECT count(*) FROM documents)
    ELSE (SELECT count(*) FROM documents WHERE list_contains(c, source)) END AS visible, unrestricted
FROM r""",
}
