"""Corpus build: files to chunk store, chunk store to vector table, only where sources changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.chunks import build_chunks
from corpusmill.operators.knn import assert_uniform_dimension
from corpusmill.session import ensure_checkpoint_dir
from corpusmill.sources import files as file_source
from corpusmill.sources import manifest as manifests
from corpusmill.sources import buckettable, store, vectortable

# embed(text column) -> array<float> column, normally a pandas UDF around the caller's model
Embedder = Callable[[Column], Column]


def clean_corpus(spark: SparkSession, root: str, store_path: str, pages: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Read every file below ``root`` and write its chunks to the store, unless it is a ``dry_run``.

    Returns (path, chunks, error) of every file: its number of chunks, or why it has none.
    """
    records, failures = file_source.read_corpus(spark, root, pages=pages)
    chunks = build_chunks(records)
    if not dry_run:
        store.save_chunks(chunks, store_path)
        chunks = store.load_chunks(spark, store_path)
    done = chunks.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
    failed = failures.select("path", F.lit(0).cast("long").alias("chunks"), "error")
    return done.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def file_times(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) of the corpus files, without reading their content."""
    return file_source.scan_files(spark, root).select(
        F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"),
        (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"),
    )


def vector_rows(chunks: DataFrame, embed: Embedder, model: str, build: str | None = None) -> DataFrame:
    """Chunks as rows of the vector table."""
    embedded = chunks.withColumn("embedding", embed(F.col("text")))
    session = F.col("session_id") if "session_id" in chunks.columns else F.lit(None).cast("string")
    return embedded.select(
        "id", "text", F.col("embedding").cast("array<float>").alias("embedding"),
        vectortable.metadata_json(chunks, model, F.size("embedding"), build=build).alias("metadata"),
        "category", session.alias("session_id"), "filename", F.current_timestamp().alias("created_at"),
    )


def update_index(
    chunks: DataFrame,
    times: DataFrame,
    previous: DataFrame,
    table: DataFrame,
    embed: Embedder,
    model: str,
    rebuild: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(new vector table, new manifest) after indexing what changed.

    Only chunks of new or changed sources are embedded. Rows of changed and removed sources are
    dropped; uploads of sessions stay, also on a rebuild. Write the table, then the manifest: a
    failure in between only repeats work.
    """
    seen = manifests.seen_sources(chunks, times)
    if rebuild:
        previous = previous.limit(0)
    diff = manifests.manifest_diff(previous, seen)
    keyed = chunks.withColumn("_src", F.replace("source", F.lit("\\"), F.lit("/")))
    todo = diff.where(F.col("change").isin("new", "changed")).select(F.col("source").alias("_src"))
    # The model runs once per changed chunk, whatever reads the rows afterwards.
    ensure_checkpoint_dir(chunks.sparkSession)
    fresh = vector_rows(keyed.join(todo, "_src", "left_semi").drop("_src"), embed, model).checkpoint()
    assert_uniform_dimension(fresh)
    uploads = table.where(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
    corpus = table.where(F.col("session_id").isNull() | (F.col("session_id") == ""))
    stale = diff.where(F.col("change") != "unchanged").select("source")
    left = corpus.limit(0) if rebuild else vectortable.delete_by_sources(corpus, stale)
    ordered = fresh.withColumn("_seq", F.monotonically_increasing_id())
    merged = vectortable.upsert(left.unionByName(uploads), ordered, "_seq")
    return merged, seen


def update_buckets(
    spark: SparkSession, root: str, version: str, chunks: DataFrame, times: DataFrame, previous: DataFrame, embed: Embedder, model: str,
    rebuild: bool = False, buckets: int = buckettable.BUCKETS,
) -> tuple[list[int], DataFrame]:
    """``update_index`` on a bucketed table: (buckets rewritten, new manifest); buckets without a change stay as they are.

    Commits the table under ``version``. Save the manifest afterwards; a stop in between only repeats work.
    """
    seen = manifests.seen_sources(chunks, times)
    diff = manifests.manifest_diff(previous, seen)
    keyed = chunks.withColumn("_src", F.replace("source", F.lit("\\"), F.lit("/")))
    if not rebuild:
        todo = diff.where(F.col("change").isin("new", "changed")).select(F.col("source").alias("_src"))
        keyed = keyed.join(todo, "_src", "left_semi")
    ensure_checkpoint_dir(spark)
    # The model runs once per changed chunk, whatever reads the rows afterwards.
    fresh = vector_rows(keyed.drop("_src"), embed, model).checkpoint()
    assert_uniform_dimension(fresh)
    gone = diff.where(F.col("change") != "unchanged").select("source")
    if rebuild:
        held = buckettable.facts(spark, root).where("rows > 0 and coalesce(session_id, '') = ''")
        gone = gone.unionByName(held.select("source")).distinct()
    upload = F.coalesce(F.col("session_id"), F.lit("")) != ""
    ordered = fresh.withColumn("_seq", F.monotonically_increasing_id())
    return buckettable.change(spark, root, version, ordered, gone=gone, keep=upload, buckets=buckets), seen
