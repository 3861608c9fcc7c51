"""Quality metrics for rankings and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.text import ascii_tokens, fold, strip
from corpusmill.operators.selection import values_at

FAITHFUL_SHARE = 0.4


def is_relevant(filename: Column, text: Column, files: Column, keywords: Column) -> Column:
    """A document counts if its name holds one of the files and its text one of the keywords."""
    name, body = fold(filename), fold(text)
    return F.exists(files, lambda f: F.contains(name, fold(f))) & F.exists(
        keywords, lambda k: F.contains(body, fold(k))
    )


def ranking_metrics(results: DataFrame, k: int) -> DataFrame:
    """Per query: hit, mrr, prec, recall, ndcg from (query_id, rank, relevant).

    Precision divides by the number of returned documents, recall equals hit, and the ideal order is
    that of the returned documents.
    """
    relevant = F.col("relevant") & (F.col("rank") <= k)
    gain = F.when(relevant, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    per_query = results.groupBy("query_id").agg(
        F.min(F.when(relevant, F.col("rank"))).alias("_first"),
        F.sum(relevant.cast("int")).alias("_rel"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(gain).alias("_dcg"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("_rel").cast("int"), F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1.0)),
    )
    found = F.col("_first").isNotNull()
    return per_query.select(
        "query_id",
        found.alias("hit"),
        F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("mrr"),
        (F.col("_rel") / F.col("_n")).alias("prec"),
        found.cast("double").alias("recall"),
        F.when(F.col("_rel") > 0, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def macro_average(per_query: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column over rows that have it; no rows means 0."""
    return per_query.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns])


def lexical_f1(pairs: DataFrame, pair_id: list[str], predicted: str, reference: str) -> DataFrame:
    """Multiset token overlap F1 per pair; pairs without tokens on a side get 0.

    Tokens are counted per (pair, token) with map-side combining, so texts of any length work.
    """
    sides = [
        pairs.select(*pair_id, F.lit(i).alias("_s"), F.explode_outer(ascii_tokens(F.col(c))).alias("_t"))
        for i, c in enumerate((predicted, reference))
    ]
    counted = sides[0].unionByName(sides[1]).groupBy(*pair_id, "_t").agg(
        F.sum(F.when((F.col("_s") == 0) & F.col("_t").isNotNull(), 1).otherwise(0)).alias("_p"),
        F.sum(F.when((F.col("_s") == 1) & F.col("_t").isNotNull(), 1).otherwise(0)).alias("_r"),
    )
    totals = counted.groupBy(*pair_id).agg(
        F.sum("_p").alias("_np"), F.sum("_r").alias("_nr"), F.sum(F.least("_p", "_r")).alias("_o")
    )
    precision, recall = F.col("_o") / F.col("_np"), F.col("_o") / F.col("_nr")
    score = F.when(F.col("_o") > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(0.0)
    return totals.select(*pair_id, score.alias("f1"))


def keyword_coverage(keywords: Column, answer: Column) -> Column:
    """Share of keywords contained in the answer, ignoring accents and case; no keywords gives 0."""
    body = fold(answer)
    hits = F.size(F.filter(keywords, lambda k: F.contains(body, fold(k))))
    return F.when(F.size(keywords) > 0, hits.cast("double") / F.size(keywords)).otherwise(0.0)


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of answer sentences with at least 40 % of their words in one of the contexts."""
    parts = F.split(F.coalesce(answer, F.lit("")), r"[.?!;\n]+")
    sentences = F.filter(parts, lambda s: F.length(strip(s)) > 5)
    sets = F.transform(contexts, lambda c: F.array_distinct(ascii_tokens(c)))

    def supported(sentence: Column) -> Column:
        words = F.array_distinct(ascii_tokens(sentence))
        return (F.size(words) > 0) & F.exists(
            sets, lambda c: F.size(F.array_intersect(words, c)).cast("double") / F.size(words) >= FAITHFUL_SHARE
        )

    ok = F.size(F.filter(sentences, supported)).cast("double")
    return F.when(F.size(sentences) > 0, ok / F.size(sentences)).otherwise(0.0)


def is_refusal(answer: Column) -> Column:
    return fold(answer).rlike("|".join(fixed.REFUSAL_MARKERS))


def refusal_rate(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(n, refusal_rate) over rows with an answer; null when there is none."""
    return answers.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(answer).isNotNull(), is_refusal(F.col(answer)).cast("double"))).alias("refusal_rate"),
    )


def latency_stats(df: DataFrame, value: str) -> DataFrame:
    """mean_ms, p50_ms (interpolated median), p95_ms (nearest rank, half to even) and n; zeros for no value."""

    def positions(n: int) -> list[int]:
        return [(n - 1) // 2, n // 2, min(n - 1, round((n - 1) * 0.95))] if n else []

    found = values_at(df, value, positions) or [0.0, 0.0, 0.0]
    stats = df.agg(F.avg(F.col(value).cast("double")).alias("m"), F.count(value).alias("n"))
    return stats.select(
        F.coalesce("m", F.lit(0.0)).alias("mean_ms"),
        F.lit((found[0] + found[1]) / 2.0).alias("p50_ms"),
        F.lit(found[2]).alias("p95_ms"),
        "n",
    )


def smoke_summary(runs: DataFrame) -> DataFrame:
    """Roll-up of a smoke run: (ok, latency, sources, keywords_hit, keywords) rows to one verdict."""
    ok = F.col("ok")
    done = runs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ok.cast("long")).alias("ok_n"),
        F.coalesce(F.avg(F.when(ok, F.col("latency").cast("double"))), F.lit(0.0)).alias("latency_mean"),
        F.coalesce(F.max(F.when(ok, F.col("latency").cast("double"))), F.lit(0.0)).alias("latency_max"),
        F.sum((ok & (F.col("sources") == 0)).cast("long")).alias("no_source"),
        F.sum((ok & (F.col("keywords") > 0) & (F.col("keywords_hit") == F.col("keywords"))).cast("long")).alias(
            "all_keywords"
        ),
    )
    failed = (F.col("ok_n") < F.col("n")) | (F.col("no_source") / F.col("ok_n") > 0.4)
    return done.withColumn("passed", ~F.coalesce(failed, F.lit(False)))
