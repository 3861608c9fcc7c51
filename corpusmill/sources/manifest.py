"""Which sources changed since the last index run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.functions.text import posix_path


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, mtime) of the last run, from a JSON map or a table written by ``save_manifest``."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        entries = whole.select(F.explode(F.from_json("value", "map<string,double>")).alias("source", "mtime"))
        return entries.select(posix_path(F.col("source")).alias("source"), "mtime")
    return spark.read.schema(schema.MANIFEST).parquet(path)


def save_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select("source", "mtime").write.mode("overwrite").parquet(path)


def seen_sources(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(source, mtime) of every source with chunks; a source whose file is gone has time 0."""
    sources = chunks.select(posix_path(F.col("source")).alias("source")).distinct()
    times = files.select(posix_path(F.col("path")).alias("source"), F.col("mtime").cast("double").alias("mtime"))
    return sources.join(times, "source", "left").select("source", F.coalesce("mtime", F.lit(0.0)).alias("mtime"))


def manifest_diff(previous: DataFrame, seen: DataFrame) -> DataFrame:
    """(source, mtime, change): new, changed, unchanged or removed, from one full outer join."""
    old = previous.select(posix_path(F.col("source")).alias("source"), F.col("mtime").alias("_old"))
    joined = seen.join(old, "source", "full_outer")
    change = (
        F.when(F.col("mtime").isNull(), "removed")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_old") == F.col("mtime"), "unchanged")
        .otherwise("changed")
    )
    return joined.select("source", F.coalesce("mtime", "_old").alias("mtime"), change.alias("change"))
