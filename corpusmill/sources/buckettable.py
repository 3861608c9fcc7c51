"""The vector table in hash buckets, each with a version of its own.

Layout below the root:

* ``data/<version>/bucket=<n>``: rows of the buckets that a version wrote,
* ``facts/<version>/bucket=<n>``: counts of these rows by source, session, file, category, mode, type, model and dimension, and one
  empty row per bucket, so that a bucket whose last row went is known as well,
* ``_manifest/<number>``: the version of every bucket. The newest complete manifest is the table.

A change rewrites only the buckets it touches. Folders are only ever added, in the order data, facts, manifest; a stop at
any point leaves the old table, and repeating the change finishes it. Where a source or session lives, and all
counts, are read from facts, never from the rows.

Ids are ``file-page-index``: the bucket follows from the file part, so equal ids always share one bucket
and a file's chunks are rewritten together. A bucket is written in pieces by id, so a file that holds a third of
all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import schema
from corpusmill.functions.text import posix_path
from corpusmill.sources import vectortable
from corpusmill.sources.vectortable import metadata_field

BUCKETS = 64
#: Pieces of a bucket's rows when it is written.
PIECES = 8
_DATA, _FACTS, _MANIFEST = "data", "facts", "_manifest"
FACTS = "source string, session_id string, filename string, category string, chunk_mode string, chunk_type string, model string, dimension int, rows long"
_ROWS = T.StructType([*schema.VECTOR_TABLE.fields, T.StructField("bucket", T.IntegerType())])


def bucket_of(id_: Column, buckets: int = BUCKETS) -> Column:
    """Bucket by the file part of an id; an id of another form is its own file part."""
    file = F.regexp_replace(F.coalesce(id_.cast("string"), F.lit("")), r"-[^-]*-[^-]*$", "")
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Version of each bucket that was ever written; at most one entry per bucket."""
    number = _newest(spark, root)
    if number is None:
        fs, path = vectortable._fs(spark, f"{root}/{_DATA}")
        if fs.exists(path) and any(vectortable._complete(fs, f.getPath()) for f in fs.listStatus(path)) and not _first_stop(spark, root):
            raise RuntimeError(f"{root} has data but no complete manifest")
        return {}
    return {r.bucket: r.version for r in spark.read.parquet(f"{root}/{_MANIFEST}/{number:012d}").collect()}


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, path = vectortable._fs(spark, f"{root}/{_MANIFEST}")
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and vectortable._complete(fs, p))


def _newest(spark: SparkSession, root: str) -> int | None:
    return max(_numbers(spark, root), default=None)


def _first_stop(spark: SparkSession, root: str) -> bool:
    """Whether only the very first version is there, left before its manifest: then the table is still empty."""
    fs, path = vectortable._fs(spark, f"{root}/{_DATA}")
    return len(fs.listStatus(path)) == 1


def _open(spark: SparkSession, root: str, kind: str, of: dict[int, str], fields) -> DataFrame:
    """Rows of the buckets ``of``, with ``bucket``; folders of buckets without rows are not there."""
    parts = []
    by_version: dict[str, list[int]] = {}
    for bucket, version in of.items():
        by_version.setdefault(version, []).append(bucket)
    for version, buckets in sorted(by_version.items()):
        rows = spark.read.schema(fields).parquet(f"{root}/{kind}/{version}").where(F.col("bucket").isin(buckets))
        parts.append(rows)
    if not parts:
        return spark.createDataFrame([], fields)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets. The bucket is a partition column, so others' files are not opened."""
    of = versions(spark, root)
    return _open(spark, root, _DATA, of if only is None else {b: v for b, v in of.items() if b in only}, _ROWS).drop("bucket")


def facts(spark: SparkSession, root: str) -> DataFrame:
    return _open(spark, root, _FACTS, versions(spark, root), f"{FACTS}, bucket int")


def _facts_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        "bucket", posix_path(metadata_field("source")).alias("source"), "session_id", "filename",
        metadata_field("category").alias("category"), metadata_field("chunk_mode").alias("chunk_mode"),
        metadata_field("chunk_type").alias("chunk_type"), metadata_field("embedding_model").alias("model"),
        F.size("embedding").alias("dimension"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def commit(rows: DataFrame, root: str, version: str, touched: list[int], buckets: int = BUCKETS) -> None:
    """Make ``rows`` the whole content of the buckets ``touched``, under the name ``version``.

    A version left incomplete by a stop is written again, a complete one is never changed; the manifest follows last.
    """
    spark = rows.sparkSession
    data, told = f"{root}/{_DATA}/{version}", f"{root}/{_FACTS}/{version}"
    fields = [F.col(f.name).cast(f.dataType) for f in schema.VECTOR_TABLE.fields]
    if not vectortable.is_complete(spark, root, f"{_DATA}/{version}"):
        placed = rows.select(*fields).withColumn("bucket", bucket_of(F.col("id"), buckets)).where(F.col("bucket").isin(touched))
        spread = placed.repartition(max(1, len(touched)) * PIECES, "bucket", F.pmod(F.xxhash64("id"), F.lit(PIECES)))
        spread.write.mode("overwrite").partitionBy("bucket").parquet(data)
    if not vectortable.is_complete(spark, root, f"{_FACTS}/{version}"):
        written = spark.read.schema(_ROWS).parquet(data)
        empty = spark.createDataFrame([(b, 0) for b in touched], "bucket int, rows long")
        told_rows = _facts_of(written).unionByName(empty, allowMissingColumns=True)
        told_rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(told)
    publish(spark, root, version)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Add the manifest in which the buckets of a complete version have that version, if it isn't there."""
    number = _newest(spark, root)
    current = versions(spark, root) if number is not None else {}
    touched = [r.bucket for r in spark.read.schema(f"{FACTS}, bucket int").parquet(f"{root}/{_FACTS}/{version}").select("bucket").distinct().collect()]
    if touched and all(current.get(b) == version for b in touched):
        return
    now = current | dict.fromkeys(touched, version)
    target = f"{root}/{_MANIFEST}/{(number or 0) + 1:012d}"
    spark.createDataFrame(sorted(now.items()), "bucket int, version string").coalesce(1).write.mode("overwrite").parquet(target)


def _buckets_in(rows: DataFrame, buckets: int) -> list[int]:
    """Bucket numbers of ids: at most ``buckets`` values."""
    return [r.b for r in rows.select(bucket_of(F.col("id"), buckets).alias("b")).distinct().collect()]


def change(
    spark: SparkSession, root: str, version: str, incoming: DataFrame | None = None, order: str = "_seq",
    gone: DataFrame | None = None, keep: Column | None = None, buckets: int = BUCKETS,
) -> list[int]:
    """One change: drop the rows of the sources ``gone`` (unless ``keep`` holds), upsert ``incoming`` by id; the buckets rewritten.

    Within ``incoming`` the last row by ``order`` wins. Sources are found through facts. A version that is complete is only published.
    """
    if vectortable.is_complete(spark, root, f"{_FACTS}/{version}"):
        publish(spark, root, version)
        return [b for b, v in versions(spark, root).items() if v == version]
    touched: set[int] = set(_buckets_in(incoming, buckets)) if incoming is not None else set()
    if gone is not None:
        listed = gone.select(posix_path(F.col("source")).alias("source")).where("source <> ''").distinct()
        touched |= {r.bucket for r in facts(spark, root).where("rows > 0").join(listed, "source", "left_semi").select("bucket").distinct().collect()}
    if not touched:
        return []
    rows = read(spark, root, sorted(touched))
    if gone is not None:
        left = vectortable.delete_by_sources(rows if keep is None else rows.where(~keep), gone)
        rows = left if keep is None else left.unionByName(rows.where(keep))
    if incoming is not None:
        rows = vectortable.upsert(rows, incoming, order)
    commit(rows, root, version, sorted(touched), buckets)
    return sorted(touched)


def delete_sessions(spark: SparkSession, root: str, version: str, sessions: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Drop the uploads of the listed sessions; only buckets that hold any are rewritten."""
    if vectortable.is_complete(spark, root, f"{_FACTS}/{version}"):
        publish(spark, root, version)
        return [b for b, v in versions(spark, root).items() if v == version]
    held = facts(spark, root).where("rows > 0").join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    touched = [r.bucket for r in held.select("bucket").distinct().collect()]
    if touched:
        commit(vectortable.delete_sessions(read(spark, root, touched), sessions), root, version, touched, buckets)
    return sorted(touched)


def table_stats(spark: SparkSession, root: str) -> DataFrame:
    """(kind, value, rows) as ``vectortable.table_stats`` gives them, from facts alone."""

    def tag(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    tags = F.array(
        tag("total", F.lit("all")),
        tag("dimension", F.col("dimension").cast("string")),
        tag("category", F.coalesce("category", F.lit("unknown"))),
        tag("chunk_mode", F.coalesce("chunk_mode", F.lit("unknown"))),
        tag("chunk_type", F.coalesce("chunk_type", F.lit("text"))),
        tag("embedding_model", F.col("model")),
    )
    rows = facts(spark, root).where("rows > 0").select("rows", F.explode(tags).alias("t")).where(F.col("t.value").isNotNull())
    return rows.groupBy("t.kind", "t.value").agg(F.sum("rows").alias("rows"))


def count_by_session(spark: SparkSession, root: str) -> DataFrame:
    held = facts(spark, root).where("rows > 0 and session_id is not null")
    return held.groupBy("session_id").agg(F.sum("rows").alias("chunks"))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove bucket folders that none of the newest ``keep`` manifests names; returns what went.

    For a table with one writer, while no reader uses an older manifest.
    """
    numbers = _numbers(spark, root)[-keep:]
    if not numbers:
        return []
    live = {
        (r.version, r.bucket)
        for n in numbers for r in spark.read.parquet(f"{root}/{_MANIFEST}/{n:012d}").collect()
    }
    gone = []
    for kind in (_DATA, _FACTS):
        fs, path = vectortable._fs(spark, f"{root}/{kind}")
        for version in fs.listStatus(path):
            name = version.getPath().getName()
            if not vectortable._complete(fs, version.getPath()):
                continue  # perhaps being written
            for part in fs.listStatus(version.getPath()):
                p = part.getPath()
                if p.getName().startswith("bucket=") and (name, int(p.getName()[7:])) not in live:
                    fs.delete(p, True)
                    gone.append(f"{kind}/{name}/{p.getName()}")
    return sorted(gone)
