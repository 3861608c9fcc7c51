"""Corpus preparation, store and index maintenance queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.functions import chunking
from corpusmill.functions.text import clean_text, normalize_text, split_sentences, text_key
from corpusmill.operators import chunks as chunk_ops
from corpusmill.operators import dedup
from corpusmill.plans.queries_retrieval import fill
from corpusmill.plans.tables import documents, table
from corpusmill.session import ensure_checkpoint_dir, widen
from corpusmill.sources import buckettable, manifest, store, vectortable


def _md5(col):
    return F.md5(col.cast("binary"))


def clean_lines(spark, folder):
    cleaned = clean_text(F.col("text"))
    docs = widen(documents(spark, folder).select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", cleaned.alias("c")).select(
        "doc_id", F.length("c").cast("long").alias("chars"), _md5(F.col("c")).alias("md5")
    )


def normalize(spark, folder):
    return documents(spark, folder).select("doc_id", text_key(F.col("text")).alias("key"))


def exact_dedup(spark, folder):
    return dedup.exact_dedup(documents(spark, folder), "doc_id").select("doc_id", "lang", "source", "n_chars")


def duplicate_groups(spark, folder):
    return dedup.duplicate_groups(documents(spark, folder), "doc_id", keys=["lang"])


def _positioned(spark, folder):
    return dedup.dense_position(documents(spark, folder).select("doc_id", "source", "text"), ["source"], "doc_id")


def neardup_pairs(spark, folder):
    return dedup.near_pairs(_positioned(spark, folder), ["source"], "doc_id", "position", threshold=0.5).withColumn(
        "jaccard", F.round("jaccard", 6)
    )


def fuzzy_dedup(spark, folder):
    kept = dedup.fuzzy_dedup(_positioned(spark, folder), ["source"], "position")
    return kept.select("doc_id", "source", "position")


def fuzzy_dedup_segmented(spark, folder):
    """The whole corpus as one group, so that it must be cut into segments."""
    rows = documents(spark, folder).select("doc_id", "text", F.lit("corpus").alias("source"))
    return dedup.fuzzy_dedup(rows, ["source"], "doc_id", segment_rows=250).select("doc_id")


def sentences(spark, folder):
    parts = documents(spark, folder).select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "s"))
    return parts.select("doc_id", F.col("pos").cast("long").alias("pos"), _md5(F.col("s")).alias("md5"))


def _pieces(df, column):
    return df.select("doc_id", F.posexplode(column).alias("pos", "c")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.length("c").cast("long").alias("chars"), _md5(F.col("c")).alias("md5")
    )


def fast_chunk(spark, folder):
    return _pieces(chunking.fast_chunks(documents(spark, folder).select("doc_id", "text"), "text"), "chunks")


def contextual_chunk(spark, folder):
    docs = documents(spark, folder).select("doc_id", "source", clean_text(F.col("text")).alias("text"))
    return _pieces(chunking.contextual_chunks(docs, "text", category=F.col("source")), "chunks")


def _legal(spark, folder):
    """Documents laid out as a numbered regulation: a heading, clauses and subclauses from their lines."""
    numbered = F.array_join(
        F.transform(
            F.split(clean_text(F.col("text")), "\n"),
            lambda s, i: F.when(i % 6 == 0, F.concat(F.lit("Điều "), (i / 6 + 1).cast("int").cast("string"), F.lit(". Heading")))
            .when(i % 6 == 1, F.concat(F.lit("1. "), s))
            .when(i % 6 < 4, F.concat(F.lit("1."), (i % 6 - 1).cast("string"), F.lit(". "), s))
            .otherwise(s),
        ),
        "\n",
    )
    return documents(spark, folder).select("doc_id", numbered.alias("text"))


def sections(spark, folder):
    cut = _legal(spark, folder).select("doc_id", F.posexplode(chunking.split_sections(F.col("text"))).alias("pos", "s"))
    return cut.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("s.heading").alias("heading"), _md5(F.col("s.body")).alias("md5")
    )


def hierarchical(spark, folder):
    cut = _legal(spark, folder).select("doc_id", F.posexplode(chunking.split_sections(F.col("text"))).alias("sec", "s"))
    units = cut.select(
        "doc_id", F.col("sec").cast("long").alias("sec"),
        F.posexplode(chunking.split_numbered(F.col("s.heading"), F.col("s.body"))).alias("pos", "u"),
    )
    return units.select(
        "doc_id", "sec", F.col("pos").cast("long").alias("pos"), _md5(F.col("u.heading")).alias("heading_md5"), _md5(F.col("u.text")).alias("md5")
    )


def _records(spark, folder):
    null = F.lit(None)
    return documents(spark, folder).select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("source"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("source").alias("category"), F.col("lang").alias("subcategory"), F.lit(0).alias("rec_no"), "text",
        F.lit(0).alias("page"), F.lit("txt").alias("kind"), F.lit("text").alias("block_type"),
        null.cast("array<double>").alias("bbox"), null.cast(schema.TABLE).alias("table_data"),
        null.cast(schema.IMAGE).alias("image_info"),
    )


def build_chunks(spark, folder):
    built = chunk_ops.build_chunks(_records(spark, folder))
    return built.select("id", "category", "subcategory", "chunk_index", "chunk_mode", "parent_context", _md5(F.col("text")).alias("md5"))


def _order_grids(spark, folder):
    """Each order as a small table of field and value."""
    fields = {"status": "o_orderstatus", "priority": "o_orderpriority", "customer": "o_custkey"}
    rows = F.array(*[F.array(F.lit(label), F.col(c).cast("string")) for label, c in fields.items()])
    return table(spark, folder, "orders").select("o_orderkey", F.array(F.lit("field"), F.lit("value")).alias("headers"), rows.alias("rows"))


def table_markdown(spark, folder):
    text = chunk_ops.markdown_table(F.col("headers"), F.concat(F.array("headers"), F.col("rows")))
    return _order_grids(spark, folder).select("o_orderkey", text.alias("markdown"))


def table_pieces(spark, folder):
    text = chunk_ops.markdown_table(F.col("headers"), F.col("rows"))
    pieces = _order_grids(spark, folder).select("o_orderkey", F.posexplode(chunk_ops.split_table_text(text, 40)).alias("pos", "piece"))
    return pieces.withColumn("pos", F.col("pos").cast("long"))


def _stored(spark, folder):
    docs = documents(spark, folder)
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("category"), F.col("lang").alias("subcategory"),
        F.concat(F.lit("f"), F.col("doc_id") % 40).alias("filename"),
        F.concat(F.col("source"), F.lit("\\"), F.col("lang"), F.lit("\\f"), F.col("doc_id") % 40).alias("source"),
        (F.col("doc_id") % 12).cast("int").alias("page"), F.col("doc_id").cast("int").alias("chunk_index"),
        F.when(F.col("n_chars") > 1500, "contextual").when(F.col("n_chars") > 400, "semantic").alias("chunk_mode"),
    )


def store_stats(spark, folder):
    return store.store_stats(_stored(spark, folder))


def manifest_diff(spark, folder):
    docs = documents(spark, folder).select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("source"), "doc_id", F.col("n_chars").cast("double").alias("mtime")
    )
    old = docs.where(F.col("doc_id") % 5 != 0).select(
        F.replace("source", F.lit("/"), F.lit("\\")).alias("source"),
        F.when(F.col("doc_id") % 7 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"),
    )
    return manifest.manifest_diff(old, docs.where(F.col("doc_id") % 11 != 3).select("source", "mtime"))


def _vector_rows(spark, folder):
    stored = _stored(spark, folder)
    meta = F.to_json(F.struct("category", "filename", "source", "page", "chunk_mode"))
    return stored.select(
        "id", "text", F.lit(None).cast("array<float>").alias("embedding"), meta.alias("metadata"), "category",
        F.when(F.col("page") < 4, F.concat(F.lit("s"), F.col("page") % 3)).alias("session_id"), "filename",
        F.timestamp_seconds(F.col("chunk_index")).alias("created_at"), F.col("chunk_index").alias("seq"),
    )


def upsert(spark, folder):
    rows = _vector_rows(spark, folder)
    existing = rows.where(F.col("seq") % 3 != 0).drop("seq")
    half = F.floor(F.col("seq") / 2).cast("long").cast("string")
    incoming = rows.withColumn("id", half).withColumn("created_at", F.timestamp_seconds(F.lit(99))).withColumn(
        "text", F.concat(F.lit("v"), F.col("seq"))
    )
    out = vectortable.upsert(existing, incoming, "seq")
    return out.select("id", _md5(F.col("text")).alias("md5"), F.unix_seconds("created_at").alias("created"))


def delete_by_source(spark, folder):
    rows = _vector_rows(spark, folder).drop("seq")
    gone = documents(spark, folder).where("lang = 'en'").select(
        F.concat(F.col("source"), F.lit("/en/f"), F.col("doc_id") % 20).alias("source")
    )
    left = vectortable.delete_by_sources(rows, gone)
    return left.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


def uploads_by_session(spark, folder):
    return vectortable.uploads_by_session(_vector_rows(spark, folder)).withColumn("page", F.col("page").cast("long"))


def _with_vectors(spark, folder):
    """All rows; those of a number that a vector has get it."""
    own = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return _vector_rows(spark, folder).drop("embedding").join(own, "id", "left")


def vector_table_stats(spark, folder):
    return vectortable.table_stats(_with_vectors(spark, folder))


def _bucket_root(spark):
    return f"{ensure_checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex}"


def bucket_upsert(spark, folder):
    """``upsert`` through a bucketed table: one version of existing rows, one that rewrites the buckets of the incoming."""
    rows, root = _vector_rows(spark, folder), _bucket_root(spark)
    buckettable.change(spark, root, "v1", rows.where(F.col("seq") % 3 != 0), "seq", buckets=16)
    half = F.floor(F.col("seq") / 2).cast("long").cast("string")
    incoming = rows.withColumn("id", half).withColumn("created_at", F.timestamp_seconds(F.lit(99))).withColumn(
        "text", F.concat(F.lit("v"), F.col("seq"))
    )
    buckettable.change(spark, root, "v2", incoming, "seq", buckets=16)
    return buckettable.read(spark, root).select("id", _md5(F.col("text")).alias("md5"), F.unix_seconds("created_at").alias("created"))


def bucket_stats(spark, folder):
    """Counts kept with the buckets, after a version that deletes sources."""
    root = _bucket_root(spark)
    buckettable.change(spark, root, "v1", _with_vectors(spark, folder), "seq", buckets=16)
    gone = documents(spark, folder).where("lang = 'en'").select(F.concat(F.col("source"), F.lit("/en/f"), F.col("doc_id") % 20).alias("source"))
    buckettable.change(spark, root, "v2", gone=gone, buckets=16)
    return buckettable.table_stats(spark, root)


def twin_files(spark, folder):
    """A file list made from page URLs: some stems exist as Parquet, some as JSON lines, some as both."""
    pages = table(spark, folder, "pages")
    name = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/p"), F.col("page_id") % 60)
    files = pages.select(F.concat(name, F.lit(".parquet")).alias("path")).where(F.col("page_id") % 2 == 0).unionByName(
        pages.select(F.concat(name, F.lit(".jsonl")).alias("path")).where((F.col("page_id") % 2 == 1) | (F.col("page_id") % 3 != 0))
    )
    return store.processed_files(files.distinct())


def normalize_length(spark, folder):
    return documents(spark, folder).select("doc_id", _md5(normalize_text(F.col("text"), accents=False)).alias("md5"))


QUERIES = {
    "clean_lines": clean_lines,
    "normalize_text": normalize,
    "normalize_unaccented": normalize_length,
    "exact_dedup": exact_dedup,
    "duplicate_groups": duplicate_groups,
    "neardup_pairs": neardup_pairs,
    "fuzzy_dedup": fuzzy_dedup,
    "fuzzy_dedup_segmented": fuzzy_dedup_segmented,
    "sentences": sentences,
    "fast_chunk": fast_chunk,
    "contextual_chunk": contextual_chunk,
    "sections": sections,
    "hierarchical": hierarchical,
    "build_chunks": build_chunks,
    "table_markdown": table_markdown,
    "table_pieces": table_pieces,
    "store_stats": store_stats,
    "manifest_diff": manifest_diff,
    "upsert": upsert,
    "delete_by_source": delete_by_source,
    "uploads_by_session": uploads_by_session,
    "vector_table_stats": vector_table_stats,
    "bucket_upsert": bucket_upsert,
    "bucket_stats": bucket_stats,
    "twin_files": twin_files,
}
NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"
SHINGLES = "list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3)))"
STORED_SQL = """
st AS (SELECT doc_id::VARCHAR AS id, text, source AS category, lang, 'f' || (doc_id % 40) AS filename,
  source || '/' || lang || '/f' || (doc_id % 40) AS source, doc_id % 12 AS page, doc_id AS chunk_index,
  CASE WHEN n_chars > 1500 THEN 'contextual' WHEN n_chars > 400 THEN 'semantic' END AS chunk_mode FROM documents)"""
LEGAL_SQL = """
cl AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', E'\\n', 'g'), E'\\n'),
    lambda l: trim(regexp_replace(replace(replace(l, '–', '-'), '—', '-'), '\\s+', ' ', 'g'))), lambda l: l <> '') AS l0,
    list_filter(string_split(text, E'\\n'), lambda l: NOT <noise>) AS l1 FROM documents),
ln AS (SELECT doc_id, list_filter(list_transform(l1, lambda l: trim(regexp_replace(replace(replace(l, '–', '-'), '—', '-'), '\\s+', ' ', 'g'))), lambda l: l <> '') AS ls FROM cl)"""
NOISE_SQL = (
    "regexp_matches(trim(l, E' \\t\\r'), '(?i)^(s[oố]\\s*:|h[aà] n[oộ]i, ngày|trang\\s*\\d+|tm\\.|kt\\.|tl\\.|k[ýy] tên)"
    "|^(\\d{1,3}|trang|th[oô]ng b[aá]o)$|^[\\s\\x{2500}-\\x{257F}\\x{2010}-\\x{2015}¯_\\-=–—.]{3,}$')"
)
LINES_SQL = LEGAL_SQL.replace("<noise>", NOISE_SQL)
UPSERT_SQL = """
WITH e AS (SELECT doc_id::VARCHAR AS id, text, doc_id AS created FROM documents WHERE doc_id % 3 <> 0),
i AS (SELECT (doc_id // 2)::VARCHAR AS id, 'v' || max(doc_id) AS text FROM documents GROUP BY 1)
SELECT id, md5(coalesce(i.text, e.text)) AS md5, coalesce(e.created, 99) AS created FROM e FULL JOIN i USING (id)"""
STATS_SQL = "WITH" + STORED_SQL + """,
v AS (SELECT st.*, embedding FROM st LEFT JOIN embeddings ON id = vec_id::VARCHAR <where>)
SELECT 'total' AS kind, 'all' AS value, count(*) AS rows FROM v
UNION ALL SELECT 'dimension', len(embedding)::VARCHAR, count(*) FROM v WHERE embedding IS NOT NULL GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM v GROUP BY 2
UNION ALL SELECT 'chunk_mode', coalesce(chunk_mode, 'unknown'), count(*) FROM v GROUP BY 2
UNION ALL SELECT 'chunk_type', 'text', count(*) FROM v"""
ORACLES = {
    "clean_lines": "WITH" + LINES_SQL + """
SELECT doc_id, length(array_to_string(ls, E'\\n')) AS chars, md5(array_to_string(ls, E'\\n')) AS md5 FROM ln""",
    "normalize_text": f"SELECT doc_id, md5({NORM}) AS key FROM documents",
    "normalize_unaccented": """
SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS md5 FROM documents""",
    "exact_dedup": f"""
SELECT doc_id, lang, source, n_chars FROM documents WHERE {NORM} <> ''
QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) = 1""",
    "duplicate_groups": f"""
SELECT lang, md5({NORM}) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE {NORM} <> '' GROUP BY 1, 2""",
    "neardup_pairs": f"""
WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, {NORM} AS n FROM documents),
k AS (SELECT *, length(n) AS len, replace(n, ' ', '') AS s FROM n WHERE n <> ''),
h AS (SELECT *, {SHINGLES} AS g FROM k),
x AS (SELECT a.source, a.doc_id AS first_id, b.doc_id AS second_id, a.n = b.n AS same, a.g AS ga, b.g AS gb
  FROM h a JOIN h b ON a.source = b.source AND a.p < b.p AND b.p - a.p <= 30
  WHERE abs(a.len - b.len) <= 400 AND least(a.len, b.len)::DOUBLE / greatest(a.len, b.len) >= 0.6),
i AS (SELECT source, first_id, second_id, same, len(list_intersect(ga, gb))::DOUBLE AS c, len(ga) AS la, len(gb) AS lb FROM x),
j AS (SELECT source, first_id, second_id, CASE WHEN same THEN 1 ELSE c / (la + lb - c) END AS j FROM i)
SELECT source, first_id, second_id, round(j, 6) AS jaccard FROM j WHERE j >= 0.5""",
    "sentences": """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1¶', 'g'), '¶'),
  lambda x: trim(x, E' \\t\\r\\n')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, md5(unnest(l)) AS md5 FROM s""",
    "sections": "WITH" + LINES_SQL + """,
nl AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM ln),
b AS (SELECT doc_id, i // 6 AS sec, string_agg(CASE i % 6 WHEN 1 THEN '1. ' || s WHEN 2 THEN '1.1. ' || s WHEN 3 THEN '1.2. ' || s ELSE s END,
  E'\\n' ORDER BY i) AS body FROM nl WHERE i % 6 > 0 GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS pos, 'Điều ' || (sec + 1) || '. Heading' AS heading, md5(body) AS md5
FROM b
UNION ALL
-- a text of one line is a heading alone and stays whole
SELECT doc_id, 0, '', md5('Điều 1. Heading') FROM ln WHERE len(ls) = 1
UNION ALL SELECT doc_id, 0, '', md5('') FROM ln WHERE len(ls) = 0""",
    "table_markdown": """
SELECT o_orderkey, concat_ws(E'\\n', 'field | value', '--- | ---', 'status | ' || o_orderstatus, 'priority | ' || o_orderpriority,
  'customer | ' || o_custkey) AS markdown FROM orders""",
    # The longest header, rule and status lines fill 40 characters; the other two lines fit together.
    "table_pieces": """
WITH l AS (SELECT o_orderkey, 'field | value' || E'\\n' || '--- | ---' || E'\\n' || 'status | ' || o_orderstatus AS a,
  'priority | ' || o_orderpriority AS b, 'customer | ' || o_custkey AS c FROM orders)
SELECT o_orderkey, 0 AS pos, a AS piece FROM l
UNION ALL SELECT o_orderkey, 1, CASE WHEN length(b) + length(c) + 1 <= 40 THEN b || E'\\n' || c ELSE b END FROM l
UNION ALL SELECT o_orderkey, 2, c FROM l WHERE length(b) + length(c) + 1 > 40""",
    "store_stats": "WITH" + STORED_SQL + """
SELECT 'mode' AS kind, coalesce(chunk_mode, 'unknown') AS value, count(*) AS rows FROM st GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM st GROUP BY 2
UNION ALL SELECT 'total', 'all', count(*) FROM st""",
    "manifest_diff": """
WITH d AS (SELECT source || '/' || doc_id AS source, doc_id, n_chars::DOUBLE AS mtime FROM documents),
o AS (SELECT source, CASE WHEN doc_id % 7 = 0 THEN mtime - 1 ELSE mtime END AS old FROM d WHERE doc_id % 5 <> 0),
s AS (SELECT source, mtime FROM d WHERE doc_id % 11 <> 3)
SELECT source, coalesce(mtime, old) AS mtime, CASE WHEN mtime IS NULL THEN 'removed' WHEN old IS NULL THEN 'new'
  WHEN old = mtime THEN 'unchanged' ELSE 'changed' END AS change FROM s FULL JOIN o USING (source)""",
    "upsert": UPSERT_SQL,
    "delete_by_source": "WITH" + STORED_SQL + """
SELECT category, count(*) AS rows FROM st
WHERE source NOT IN (SELECT source || '/en/f' || (doc_id % 20) FROM documents WHERE lang = 'en') GROUP BY 1""",
    "uploads_by_session": "WITH" + STORED_SQL + """
SELECT 's' || (page % 3) AS session_id, filename, count(*) AS chunks, max(page::VARCHAR)::BIGINT AS page, max(category) AS category,
  max(replace(source, '/', '\\')) AS source FROM st WHERE page < 4 GROUP BY 1, 2""",
    "vector_table_stats": fill(STATS_SQL, where=""),
    "bucket_upsert": UPSERT_SQL,
    "bucket_stats": fill(STATS_SQL, where="WHERE st.source NOT IN (SELECT source || '/en/f' || (doc_id % 20) FROM documents WHERE lang = 'en')"),
    "twin_files": """
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/p' || (page_id % 60) AS stem FROM pages),
c AS (SELECT DISTINCT stem FROM p WHERE page_id % 2 = 0), j AS (SELECT DISTINCT stem FROM p WHERE page_id % 2 = 1 OR page_id % 3 <> 0)
SELECT stem || '.parquet' AS path FROM c UNION ALL SELECT stem || '.jsonl' FROM j WHERE stem NOT IN (SELECT stem FROM c)""",
}
