"""Evaluation of retrieval and answers against a golden question set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.operators import evaluation

RANKING = ["hit", "mrr", "prec", "recall", "ndcg"]


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a JSON array, numbered, with absent lists and flags filled in."""
    none = F.array().cast("array<string>")
    rows = spark.read.schema(schema.GOLDEN).option("multiLine", "true").json(path)
    files = F.coalesce("golden_files", F.array(F.coalesce("golden_file", F.lit(""))))
    return rows.select(
        F.xxhash64("question").alias("query_id"), F.col("question").alias("query"), "reference",
        files.alias("golden_files"), F.coalesce("golden_keywords", none).alias("golden_keywords"),
        F.coalesce("ref_keywords", none).alias("ref_keywords"), F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"),
    )


def judge_ranking(golden: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Ranking metrics per answerable question; a question without results scores 0."""
    asked = golden.where(~F.col("unanswerable"))
    wanted = asked.select("query_id", "golden_files", "golden_keywords")
    relevant = evaluation.is_relevant(F.col("filename"), F.col("text"), F.col("golden_files"), F.col("golden_keywords"))
    judged = results.join(wanted, "query_id").select("query_id", "rank", relevant.alias("relevant"))
    metrics = evaluation.ranking_metrics(judged, k)
    filled = asked.select("query_id").join(metrics, "query_id", "left")
    return filled.select(
        "query_id", F.coalesce("hit", F.lit(False)).alias("hit"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in RANKING[1:]]
    )


def judge_answers(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """f1, kw and faith_h per answerable question from (query_id, answer, contexts)."""
    pairs = golden.where(~F.col("unanswerable")).join(answers, "query_id")
    overlap = evaluation.lexical_f1(pairs, ["query_id"], "answer", "reference")
    own = pairs.select(
        "query_id", evaluation.keyword_coverage(F.col("ref_keywords"), F.col("answer")).alias("kw"),
        evaluation.faithfulness(F.col("answer"), F.slice("contexts", 1, 3)).alias("faith_h"),
    )
    return overlap.join(own, "query_id")


def report(golden: DataFrame, results: DataFrame, answers: DataFrame | None, k: int) -> DataFrame:
    """One row: question counts, mean ranking metrics and, with answers, mean answer metrics and refusal rate."""
    counts = golden.agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("unanswerable")).cast("long")).alias("n_answerable"))
    means = evaluation.macro_average(judge_ranking(golden, results, k), RANKING)
    columns = [counts.select(c).scalar().alias(c) for c in ("n", "n_answerable")]
    out = means.select(*columns, *RANKING)
    if answers is not None:
        judged = evaluation.macro_average(judge_answers(golden, answers), ["f1", "kw", "faith_h"])
        refused = evaluation.refusal_rate(golden.where("unanswerable").join(answers, "query_id"))
        out = out.select(
            "*", *[judged.select(c).scalar().alias(c) for c in ("f1", "kw", "faith_h")],
            refused.select("refusal_rate").scalar().alias("refusal_rate"),
        )
    return out
