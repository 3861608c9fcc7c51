"""The vector table: upsert, deletes and counts on immutable Parquet versions.

Every change is a new DataFrame over the old one; ``commit`` writes it as a new version folder and
then moves the pointer, so readers see the old version or the new one and a lost executor or driver
leaves the old one in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.functions.text import posix_path
from corpusmill.operators.bm25 import rank_within

_POINTERS = "_current"


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The current version, or an empty table if none was ever written.

    Raises if there are complete versions but no readable pointer: an empty table would then be wrong.
    """
    version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema.VECTOR_TABLE)
    return spark.read.schema(schema.VECTOR_TABLE).parquet(f"{root}/{version}")


def current_version(spark: SparkSession, root: str) -> str | None:
    """Version named by the newest complete pointer."""
    numbers = _pointer_numbers(spark, root)
    if numbers:
        return spark.read.text(f"{root}/{_POINTERS}/{max(numbers):012d}").first()[0]
    fs, path = _fs(spark, root)
    if fs.exists(path) and any(_complete(fs, f.getPath()) for f in fs.listStatus(path)):
        raise RuntimeError(f"{root} has versions but no complete pointer to one")
    return None


def commit(table: DataFrame, root: str, version: str) -> None:
    """Write ``table`` as a version and make it current.

    A version folder left incomplete by a failure is written again; a complete one is never changed.
    Pointers are only ever added, under the next number, and count once they are complete: a failure at any point
    leaves the old version current, and a repeated commit finishes the job.
    """
    if not is_complete(table.sparkSession, root, version):
        table.select(*[F.col(f.name).cast(f.dataType) for f in schema.VECTOR_TABLE.fields]).write.mode(
            "overwrite"
        ).partitionBy("category").parquet(f"{root}/{version}")
    publish(table.sparkSession, root, version)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make a complete version current, if it isn't."""
    numbers = _pointer_numbers(spark, root)
    if numbers and current_version(spark, root) == version:
        return
    # An incomplete pointer of the next number may lie there; it never counted.
    target = f"{root}/{_POINTERS}/{max(numbers, default=0) + 1:012d}"
    spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(target)


def is_complete(spark: SparkSession, root: str, version: str) -> bool:
    return _complete(*_fs(spark, f"{root}/{version}"))


def _pointer_numbers(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, f"{root}/{_POINTERS}")
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path)]
    return [int(p.getName()) for p in found if p.getName().isdigit() and _complete(fs, p)]


def _complete(fs, path) -> bool:
    return fs.exists(path.suffix("/_SUCCESS"))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def upsert(existing: DataFrame, incoming: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Replace rows by key; within ``incoming`` the last row by ``order`` wins, ``created_at`` stays.

    The group limit keeps one row per key and task before the shuffle, so a key sent a billion times
    is no hot spot.
    """
    last = rank_within(incoming, 1, [key], [F.desc(order)], "_nth").drop("_nth", order)
    created = existing.select(key, F.col("created_at").alias("_born"))
    stamped = last.join(created, key, "left").withColumn("created_at", F.coalesce("_born", "created_at")).drop("_born")
    return existing.join(last.select(key), key, "left_anti").unionByName(stamped.select(*existing.columns))


def metadata_field(name: str, metadata: str = "metadata") -> Column:
    return F.get_json_object(F.col(metadata), f"$.{name}")


def delete_by_sources(table: DataFrame, sources: DataFrame) -> DataFrame:
    """Drop the rows whose metadata source (with forward slashes) is listed."""
    listed = sources.select(posix_path(F.col("source")).alias("_src")).where(F.col("_src") != "").distinct()
    keyed = table.withColumn("_src", posix_path(metadata_field("source")))
    return keyed.join(listed, "_src", "left_anti").select(*table.columns)


def delete_by_session(table: DataFrame, session_id: str, filename: str | None = None) -> DataFrame:
    """Drop the uploads of a session, or of one of its files."""
    gone = F.col("session_id") == session_id
    if filename is not None:
        gone = gone & (F.col("filename") == filename)
    return table.where(~F.coalesce(gone, F.lit(False)))


def delete_sessions(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drop the uploads of every listed session (expired or evicted ones)."""
    return table.join(sessions.select("session_id").distinct(), "session_id", "left_anti").select(*table.columns)


def upload_facts(table: DataFrame) -> DataFrame:
    """Chunks and distinct pages per uploaded file."""
    uploads = table.where(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
    return uploads.groupBy("session_id", "filename").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct(metadata_field("page")).alias("pages")
    )


def uploads_by_session(table: DataFrame) -> DataFrame:
    """Per session and file: chunk count, largest page *text*, category and source."""
    uploads = table.where(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
    grouped = uploads.groupBy("session_id", "filename").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.max(metadata_field("page")).alias("_page"),
        F.max("category").alias("category"),
        F.max(metadata_field("source")).alias("source"),
    )
    return grouped.select(
        "session_id", F.coalesce("filename", F.lit("unknown")).alias("filename"), "chunks",
        F.col("_page").try_cast("int").alias("page"), "category", "source",
    )


def count_by_session(table: DataFrame) -> DataFrame:
    return table.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("chunks"))


def table_stats(table: DataFrame) -> DataFrame:
    """(kind, value, rows) over the whole table: total, dimension, category, chunk mode and type, model."""
    def tag(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    tags = F.array(
        tag("total", F.lit("all")),
        tag("dimension", F.size("embedding").cast("string")),
        tag("category", F.coalesce(metadata_field("category"), F.lit("unknown"))),
        tag("chunk_mode", F.coalesce(metadata_field("chunk_mode"), F.lit("unknown"))),
        tag("chunk_type", F.coalesce(metadata_field("chunk_type"), F.lit("text"))),
        tag("embedding_model", metadata_field("embedding_model")),
    )
    exploded = table.select(F.explode(tags).alias("t")).where(F.col("t.value").isNotNull())
    return exploded.groupBy("t.kind", "t.value").agg(F.count(F.lit(1)).alias("rows"))


def json_safe(col: Column) -> Column:
    """NaN and infinities have no JSON form and become null."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col)


def metadata_json(chunks: DataFrame, model: str, dimension: Column, cap: int = 3000, build: str | None = None) -> Column:
    """Metadata of a chunk row as JSON text; nested extras are JSON strings of at most ``cap`` characters.

    ``build`` names the state of the chunk store that the row comes from.
    """
    kinds = {f.name: f.dataType.typeName() for f in chunks.schema.fields}

    def extra(name: str) -> Column:
        col = F.col(name)
        return F.substring(F.to_json(col), 1, cap).alias(name) if kinds[name] in ("array", "struct", "map") else col

    extras = [
        extra(n)
        for n in ("chunk_type", "block_type", "has_table", "has_image", "parent_context", "bbox", "table_data", "image_info")
        if n in kinds
    ]
    session = [F.col("session_id")] if "session_id" in kinds else []
    return F.to_json(
        F.struct(
            "category", "subcategory", "filename", "source", "page", "chunk_index",
            F.coalesce("chunk_mode", F.lit("unknown")).alias("chunk_mode"),
            F.length("text").alias("text_length"), F.lit(model).alias("embedding_model"),
            dimension.alias("embedding_dim"), *session, *extras, *([F.lit(build).alias("build")] if build else []),
        )
    )
