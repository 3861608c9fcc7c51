"""Service state files: sessions, users and the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import fixed, schema


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    """The request log; lines that are not valid JSON are skipped."""
    wide = T.StructType([*schema.CHAT_LOG.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(wide).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def append_chat_log(log: DataFrame, path: str) -> None:
    log.select(*[f.name for f in schema.CHAT_LOG.fields]).withColumn(
        "latency", F.round("latency", 3)
    ).withColumn("standalone", F.substring("standalone", 1, 200)).write.mode("append").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session rows with defaults filled in; ``path`` holds one session per JSON line."""
    rows = spark.read.schema(schema.SESSION).json(path)
    empty = F.array().cast(schema.SESSION["history"].dataType)
    return rows.withColumn("history", F.coalesce("history", empty)).withColumn(
        "style", F.coalesce("style", F.lit(fixed.DEFAULT_STYLE))
    )


def write_sessions(sessions: DataFrame, path: str) -> None:
    sessions.write.mode("overwrite").json(path)


def session_messages(sessions: DataFrame) -> DataFrame:
    """(session_id, seq, role, content) of the stored histories."""
    return sessions.select("session_id", F.posexplode("history").alias("seq", "m")).select(
        "session_id", "seq", "m.role", "m.content"
    )


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.USER).json(path)


def create_users(existing: DataFrame, requested: DataFrame, known: list[str] = fixed.CATEGORY_ORDER) -> DataFrame:
    """New user rows that pass the checks: name 1-64, password of 6 or more, name not taken, valid categories."""
    name = F.trim("username")
    asked = F.when(F.size("categories") > 0, F.col("categories"))
    default = F.when(F.col("is_admin"), F.array(F.lit("*"))).otherwise(F.array(*[F.lit(c) for c in known]))
    valid = F.array_intersect(F.coalesce(asked, default), F.array(*[F.lit(c) for c in [*known, "*"]]))
    rows = requested.withColumn("username", name).where(
        (F.length("username").between(1, 64)) & (F.length("password") >= 6)
    )
    return rows.join(existing.select("username"), "username", "left_anti").select(
        "username", F.coalesce("is_admin", F.lit(False)).alias("is_admin"),
        F.when(F.size(valid) > 0, valid).otherwise(F.array(*[F.lit(c) for c in known])).alias("categories"),
    )
