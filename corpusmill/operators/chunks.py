"""Records of a corpus to its chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.arrays import merge_adjacent, strings
from corpusmill.functions.chunking import contextual_chunks, effective_min, fast_chunks
from corpusmill.functions.text import clean_text, lines, strip
from corpusmill.operators.bm25 import rank_within
from corpusmill.operators.dedup import dense_position, fuzzy_dedup
from corpusmill.session import ensure_checkpoint_dir, stored, widen

_TEXT_KINDS = ["pdf", "pdf_scan", "docx", "txt"]


def markdown_table(headers: Column, rows: Column) -> Column:
    """Header line, rule line and rows; a first row equal to the header is not repeated."""
    has_header = F.coalesce(F.size(headers), F.lit(0)) > 0
    body = F.when(has_header & (F.get(rows, F.lit(0)) == headers), F.slice(rows, 2, F.size(rows))).otherwise(rows)
    rule = F.array_join(F.transform(headers, lambda h: F.lit("---")), " | ")
    top = F.when(has_header, F.array(F.array_join(headers, " | "), rule)).otherwise(strings())
    return F.array_join(F.concat(top, F.transform(body, lambda r: F.array_join(r, " | "))), "\n")


def split_table_text(text: Column, max_chars: int = fixed.TABLE_MAX_CHARS) -> Column:
    """Whole lines packed up to ``max_chars``."""
    filled = F.filter(lines(text), lambda s: s != "")
    packed = merge_adjacent(
        filled, lambda a, b: F.length(a) + F.length(b) + 1 <= max_chars, "\n", strip
    )
    return F.when(F.length(text) > max_chars, packed).otherwise(strings(text))


def first_records(records: DataFrame, max_records: int = fixed.MAX_UPLOAD_RECORDS) -> DataFrame:
    """The first records of every file, as accepted for an upload."""
    return rank_within(records, max_records, ["source"], [F.asc("rec_no")], "_r").drop("_r")


def build_chunks(
    records: DataFrame,
    session_id: str | None = None,
    contextual: bool = True,
    min_chars: int = fixed.MIN_CHARS,
    max_chars: int = fixed.MAX_CHARS,
) -> DataFrame:
    """Chunk table of ``records`` (see schema.RECORD).

    Text is cleaned and chunked; tables become Markdown behind the text of their page; figures keep
    their caption. Near duplicates inside a file are removed and the rest is renumbered.
    """
    kind, block = F.coalesce("kind", F.lit("pdf")), F.coalesce("block_type", F.lit("text"))
    chunk_type = (
        F.when((kind == "pdf_table") | (block == "table"), "table")
        .when((kind == "pdf_figure") | (block == "figure"), "figure")
        .otherwise("text")
    )
    # Stored: texts are cleaned once, for their chunks and for the openings of pages.
    cleaned = records.withColumn("chunk_type", chunk_type).withColumn("_clean", clean_text(F.col("text")))
    typed = stored(widen(cleaned, "source"))
    is_parent = ((F.col("block_type") == "text") | F.col("kind").isin(_TEXT_KINDS)) & (F.col("_clean") != "")
    parents = (
        typed.where(is_parent)
        .groupBy("source", "page")
        .agg(
            F.min_by(F.substring("_clean", 1, fixed.PARENT_CHARS), "rec_no").alias("_parent"),
            F.min("rec_no").alias("_at"),
        )
    )
    opening = parents.groupBy("source").agg(F.min_by("_parent", "_at").alias("_opening"))
    extras = typed.where("chunk_type <> 'text'")
    placed = extras.join(parents.drop("_at"), ["source", "page"], "left").join(opening, "source", "left")
    context = F.coalesce("_parent", "_opening", F.lit(""))
    page = F.col("page").cast("string")
    origin = F.concat(F.col("filename"), F.lit(" trang "), page)
    lead = F.concat(F.lit("[Bối cảnh trang "), page, F.lit("]\n"), context, F.lit("\n\n"))

    # Text is chunked where it was read; only the finished pieces meet their page's opening.
    text_rows = typed.where("chunk_type = 'text'").where(F.col("_clean") != "")
    if contextual:
        text_rows = contextual_chunks(text_rows, "_clean", "_pieces", F.col("category"), min_chars, max_chars)
    else:
        text_rows = fast_chunks(text_rows, "_clean", "_pieces", min_chars, max_chars)
    low = effective_min(None)
    text_part = _part(
        text_rows, F.filter("_pieces", lambda c: F.length(strip(c)) >= low),
        "contextual" if contextual else "semantic", None,
    )
    shown = parents.select("source", "page", F.substring("_parent", 1, 100).alias("parent_context"))
    text_part = text_part.drop("parent_context").join(shown, ["source", "page"], "left").withColumn(
        "parent_context", F.coalesce("parent_context", F.lit(""))
    )

    markdown = markdown_table(F.col("table_data.headers"), F.col("table_data.rows"))
    has_rows = F.coalesce(F.size("table_data.rows"), F.lit(0)) > 0
    full = F.when(context != "", F.concat(lead, F.lit("[BẢNG - "), origin, F.lit("]\n"), markdown)).otherwise(
        F.concat(F.lit("[BẢNG trang "), page, F.lit("]\n"), markdown)
    )
    raw_table = F.when(has_rows, full).otherwise(F.col("text"))
    table_text = F.when(F.col("block_type") == "table", strip(raw_table)).otherwise(clean_text(raw_table))
    table_rows = placed.where("chunk_type = 'table'").withColumn("_t", table_text).where(F.col("_t") != "")
    table_part = _part(
        table_rows,
        F.filter(split_table_text(F.col("_t")), lambda c: F.length(strip(c)) >= fixed.TABLE_MIN_CHARS),
        "table_struct", 200,
    )

    box = F.coalesce(F.concat(F.lit("["), F.array_join("bbox", ", "), F.lit("]")), F.lit("None"))
    pictured = F.concat(lead, F.lit("[HÌNH ẢNH - "), origin, F.lit(" bbox "), box, F.lit("]\n"), F.col("text"))
    figure_text = strip(F.when(context != "", pictured).otherwise(F.col("text")))
    figure_rows = placed.where("chunk_type = 'figure'").withColumn("_t", figure_text)
    figure_part = _part(
        figure_rows.where(F.length("_t") >= fixed.FIGURE_MIN_CHARS),
        strings(F.regexp_replace(F.substring("_t", 1, fixed.FIGURE_MAX_CHARS), r"\s+$", "")),
        "figure", 200,
    )

    # Numbering and duplicate removal read the pieces several times; chunking should run once.
    ensure_checkpoint_dir(records.sparkSession)
    pieces = text_part.unionByName(table_part).unionByName(figure_part).checkpoint()
    numbered = dense_position(
        pieces.withColumn("_o", F.col("rec_no").cast("long") * (1 << 20) + F.col("_piece")), ["source"], "_o", 1 << 30
    )
    kept = fuzzy_dedup(numbered, ["source"], "position")
    final = dense_position(kept.drop("_o").withColumnRenamed("position", "_p"), ["source"], "_p")
    base = F.col("filename") if session_id is None else F.concat(F.lit(f"{session_id}-"), F.col("filename"))
    index = F.col("position").cast("int")
    return final.select(
        F.concat_ws("-", base, page, index.cast("string")).alias("id"),
        "text", "category", "subcategory", "filename", "source", "page", index.alias("chunk_index"),
        "chunk_mode", "chunk_type", "parent_context", F.to_json("bbox").alias("bbox"),
        (F.col("chunk_type") == "table").alias("has_table"), (F.col("chunk_type") == "figure").alias("has_image"),
        "block_type", F.to_json("table_data").alias("table_data"), F.to_json("image_info").alias("image_info"),
        F.lit(session_id).cast("string").alias("session_id"),
    )


def _part(rows: DataFrame, pieces: Column, mode: str, parent_chars: int | None) -> DataFrame:
    if parent_chars is None:
        shown = F.lit("")
    else:
        shown = F.substring(F.coalesce("_parent", F.lit("")), 1, parent_chars)
    return rows.select(
        "source", "rec_no", F.posexplode(pieces).alias("_piece", "text"), "category", "subcategory", "filename",
        "page", F.lit(mode).alias("chunk_mode"), "chunk_type", "block_type", shown.alias("parent_context"),
        "bbox", "table_data", "image_info",
    )


def upload_chunks(records: DataFrame, session_id: str) -> DataFrame:
    """Chunks of uploaded files; a file too short for any chunk is kept whole from 10 characters on."""
    limited = first_records(records).withColumn("category", F.lit("uploaded")).withColumn("subcategory", F.lit(""))
    chunks = build_chunks(limited, session_id)
    missing = limited.join(chunks.select("source").distinct(), "source", "left_anti")
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("rec_no", F.coalesce("text", F.lit("")).alias("t")))), lambda r: r["t"]
    )
    whole = missing.groupBy("source", "filename").agg(clean_text(F.array_join(texts, "\n")).alias("text"))
    null = F.lit(None)
    rest = whole.where(F.length("text") >= 10).select(
        F.concat(F.lit(f"{session_id}-"), F.col("filename"), F.lit("-0-0")).alias("id"),
        F.substring("text", 1, fixed.MAX_CHARS).alias("text"),
        F.lit("uploaded").alias("category"), F.lit("").alias("subcategory"), "filename", "source",
        F.lit(0).alias("page"), F.lit(0).alias("chunk_index"), F.lit("uploaded_fallback").alias("chunk_mode"),
        F.lit("text").alias("chunk_type"), null.cast("string").alias("parent_context"),
        null.cast("string").alias("bbox"), F.lit(False).alias("has_table"), F.lit(False).alias("has_image"),
        F.lit("text").alias("block_type"), null.cast("string").alias("table_data"),
        null.cast("string").alias("image_info"), F.lit(session_id).alias("session_id"),
    )
    return chunks.unionByName(rest)
