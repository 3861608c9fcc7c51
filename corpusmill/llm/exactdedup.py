"""Exact duplicates by skew-safe combining; DataFrame functions only.

Texts are equal if they are the same after deleting white space. Copies are removed in three
steps, each grouping by the digest *and the whole normalised text*: within every task before
anything is shuffled, within each (digest, salt) group, and over the at most ``salts`` winners of a
digest. A text which holds a third of all rows is therefore combined where it is read, then by
``salts`` tasks, and only a handful of rows meets in the last step. Rows learn their group through
the same (digest, salt) key, so this join is spread as widely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACES, carried, table, text_of

SALTS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, keep_n (code points of what stays).

    A null text counts as empty, and all empty texts are one group. The row with the most code points
    stays, among those the one with the smallest id (null ids last). Rows that repeat one id and one
    text each get a row and the same verdict. Other columns of ``docs`` are not looked at, so their
    names cannot clash; an empty table gives an empty result. One digest for two different texts
    raises an error instead of joining wrong rows.
    """
    rows = (
        docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
        .select("_id", F.length("_text").alias("_n"), F.translate("_text", SPACES, "").alias("_norm"))
        .withColumn("_digest", F.sha2("_norm", 256))
        .withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    )
    # Locally, then per salt: the length is a key, so that one minimum and one count suffice and fit a hash table.
    per_salt = rows.groupBy("_digest", "_salt", "_norm", "_n").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_size")
    )
    per_text = per_salt.groupBy("_digest", "_norm").agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").isNull().alias("x"), F.col("_first").alias("id"))).alias("_best"),
        F.sum("_size").alias("_size"),
        F.collect_set("_salt").alias("_salts"),
    )
    # One content per digest from here on, or none at all.
    per_digest = per_text.groupBy("_digest").agg(
        F.count("*").alias("_contents"),
        F.first("_best").alias("_best"),
        F.first("_size").alias("_size"),
        F.first("_salts").alias("_salts"),
    )
    winners = per_digest.select(
        F.col("_digest").alias("_d"),
        F.explode("_salts").alias("_s"),
        F.when(F.col("_contents") > 1, F.raise_error(F.lit("two texts share one SHA-256")).cast("long"))
        .otherwise(F.col("_size"))
        .alias("group_size"),
        F.col("_best.id").alias("keep_id"),
        (-F.col("_best.n")).alias("_keep_n"),
    )
    members = rows.select("_id", "_n", "_digest", "_salt")
    return members.join(
        winners, (F.col("_digest") == F.col("_d")) & (F.col("_salt") == F.col("_s"))
    ).select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == F.col("_keep_n"))).alias("kept"),
        F.col("_digest").alias("text_sha256"),
        F.col("_keep_n").alias("keep_n"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows that repeat an id and a text, one."""

    def key(digest, number, length):
        return F.concat_ws(":", digest, F.coalesce(number.cast("string"), F.lit("null")), length.cast("string"))

    def step(rows: DataFrame) -> DataFrame:
        kept = exact_groups(rows, salts=salts).where("kept")
        stay = kept.select(key(F.col("text_sha256"), F.col("keep_id"), F.col("keep_n")).alias("_stay")).distinct()
        digest = F.sha2(F.translate(text_of("text"), SPACES, ""), 256)
        marked = rows.withColumn("_key", key(digest, F.col("doc_id"), F.length(text_of("text"))))
        # One key, so that the rows that meet here for the join are where the last step wants them.
        return marked.join(stay, F.col("_key") == F.col("_stay"), "left_semi").dropDuplicates(["_key"])

    return carried(docs, step, {"doc_id": id_col, "text": text_col})


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("keep_n")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(n) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""
