"""The chunk store: one partition per category, plus JSON-lines files not migrated yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.operators.bm25 import rank_within


def to_store_columns(chunks: DataFrame) -> DataFrame:
    """The stored column list in order; nested columns become JSON text, missing ones null."""
    kinds = {f.name: f.dataType for f in chunks.schema.fields}

    def column(field) -> Column:
        if field.name not in kinds:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if field.name in ("bbox", "table_data", "image_info") and kinds[field.name].typeName() in ("array", "struct", "map"):
            return F.to_json(F.col(field.name)).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return chunks.select(*[column(f) for f in schema.CHUNK.fields])


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the partitions of the categories in ``chunks``; other categories stay.

    Rows are spread over tasks by category and source, so a large category is written by many tasks.
    """
    (
        to_store_columns(chunks)
        .repartition("category", "source")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("category")
        .parquet(path)
    )


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks; filters on category prune folders."""
    return spark.read.schema(schema.CHUNK).parquet(path).select(*schema.CHUNK_COLUMNS)


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks in JSON lines; broken lines are skipped."""
    rows = spark.read.schema(schema.CHUNK).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("text").isNotNull())


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def processed_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Parquet files, and the JSON-lines files without a Parquet twin of the same stem."""
    named = files.withColumn("_stem", stem(F.col(path)))
    columnar = named.where(F.col(path).endswith(".parquet"))
    lines = named.where(F.col(path).endswith(".jsonl"))
    rest = lines.join(columnar.select("_stem"), "_stem", "left_anti")
    return columnar.select(*files.columns).unionByName(rest.select(*files.columns))


def migrate_jsonl(spark: SparkSession, jsonl_path: str, path: str) -> None:
    """Append the JSON-lines chunks whose source is not in the Parquet store yet."""
    incoming = load_jsonl(spark, jsonl_path)
    stored = load_chunks(spark, path).select("source").distinct()
    fresh = incoming.join(stored, "source", "left_anti")
    to_store_columns(fresh).repartition("category", "source").write.mode("append").partitionBy("category").parquet(path)


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"))


def store_stats(chunks: DataFrame, sample_per_file: int | None = None) -> DataFrame:
    """(kind, value, rows): chunk counts by mode, by category and in total.

    ``sample_per_file`` counts modes and categories over the first chunks of each file only.
    """
    rows = chunks
    if sample_per_file:
        rows = rank_within(chunks, sample_per_file, ["source"], [F.asc("chunk_index")], "_i")
    unknown = F.lit("unknown")
    tagged = rows.select(
        F.explode(
            F.array(
                F.struct(F.lit("mode").alias("kind"), F.coalesce("chunk_mode", unknown).alias("value")),
                F.struct(F.lit("category").alias("kind"), F.coalesce("category", unknown).alias("value")),
            )
        ).alias("t")
    )
    counted = tagged.groupBy("t.kind", "t.value").agg(F.count(F.lit(1)).alias("rows"))
    total = chunks.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("total").alias("kind"), F.lit("all").alias("value"), "rows"
    )
    return counted.unionByName(total)
