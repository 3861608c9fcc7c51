"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

TABLE = T.StructType([
    T.StructField("table_index", T.IntegerType()),
    T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("page", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
IMAGE = T.StructType([
    T.StructField("image_index", T.IntegerType()),
    T.StructField("xref", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("visual_type", T.StringType()),
])
# What a file extractor returns per file, before path and category are attached.
EXTRACTED = T.StructType([
    T.StructField("rec_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("block_type", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("table_data", TABLE),
    T.StructField("image_info", IMAGE),
])
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "filename", "category", "subcategory")] + EXTRACTED.fields
)
# Page content as a PDF library delivers it; the rules that turn it into records are native.
PAGE = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("width", T.DoubleType()),
    T.StructField("plain_text", T.StringType()),
    T.StructField("ocr_text", T.StringType()),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("block_type", T.IntegerType()),
    ]))),
    T.StructField("tables", T.ArrayType(TABLE)),
    T.StructField("images", T.ArrayType(IMAGE)),
])
CHUNK_COLUMNS = [
    "id", "text", "category", "subcategory", "filename", "source", "page", "chunk_index", "chunk_mode",
    "chunk_type", "parent_context", "bbox", "has_table", "has_image", "block_type", "table_data", "image_info",
]
CHUNK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk_mode", T.StringType()),
    T.StructField("chunk_type", T.StringType()),
    T.StructField("parent_context", T.StringType()),
    T.StructField("bbox", T.StringType()),
    T.StructField("has_table", T.BooleanType()),
    T.StructField("has_image", T.BooleanType()),
    T.StructField("block_type", T.StringType()),
    T.StructField("table_data", T.StringType()),
    T.StructField("image_info", T.StringType()),
])
VECTOR_TABLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
CHAT_LOG = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("user", T.StringType()),
    T.StructField("q_len", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("sources", T.IntegerType()),
    T.StructField("no_source", T.BooleanType()),
    T.StructField("cached", T.BooleanType()),
    T.StructField("stream", T.BooleanType()),
    T.StructField("standalone", T.StringType()),
])
GOLDEN = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("golden_file", T.StringType()),
    T.StructField("golden_files", T.ArrayType(T.StringType())),
    T.StructField("golden_keywords", T.ArrayType(T.StringType())),
    T.StructField("ref_keywords", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("unanswerable", T.BooleanType()),
])
MANIFEST = T.StructType([T.StructField("source", T.StringType()), T.StructField("mtime", T.DoubleType())])
SESSION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("last_math_result", T.StringType()),
    T.StructField("created_at", T.DoubleType()),
    T.StructField("updated_at", T.DoubleType()),
    T.StructField("history", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
    ]))),
])
USER = T.StructType([
    T.StructField("username", T.StringType()),
    T.StructField("pw", T.StringType()),
    T.StructField("is_admin", T.BooleanType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("daily", T.StructType([
        T.StructField("date", T.StringType()), T.StructField("count", T.IntegerType()),
    ])),
])
