"""Batches of questions to checked answers.

Models are arguments: ``generate`` turns a prompt column into an answer column, ``score`` a question
and a text column into a relevance column. Both are normally pandas UDFs around the caller's model;
without ``score`` the retrieval order is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions import calc, guard, prompt, routing
from corpusmill.operators import rerank
from corpusmill.plans import retrieval
from corpusmill.session import ensure_checkpoint_dir

Generator = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]

_MESSAGES = "array<struct<role:string,content:string>>"


def routed(questions: DataFrame, parity: bool = False) -> DataFrame:
    """Add the cleaned question, its stand-alone form and its route.

    ``questions`` has query_id, question, history (array of role/content, may be null).
    """
    history = F.coalesce(F.col("history"), F.array().cast(_MESSAGES))
    clean = questions.withColumn("history", history).withColumn("question", guard.sanitize_input(F.col("question")))
    style = F.coalesce(routing.detect_style(F.col("question"), parity), F.lit(fixed.DEFAULT_STYLE))
    return (
        clean.withColumn("style", style)
        .withColumn("route", routing.route(F.col("question"), F.col("history"), calc.math_kind(F.col("question"), parity), parity))
        .withColumn("query", routing.rewrite_with_history(F.col("question"), F.col("history")))
    )


def retrieve_context(
    asked: DataFrame, chunks: DataFrame, top_k: int | None = None, score: Scorer | None = None, **search
) -> DataFrame:
    """(query_id, docs): the ranked passages of each query as an array of text and file name."""
    use_rerank = score is not None
    k = top_k or (fixed.RERANK_TOP_K if use_rerank else fixed.RETRIEVE_TOP_K)
    found = retrieval.hybrid_search(chunks, asked, top_k=rerank.fetch_size(k, use_rerank), **search)
    if use_rerank:
        pairs = found.join(asked.select("query_id", "query"), "query_id")
        found = rerank.rerank(pairs, score(F.col("query"), F.col("text")), k=min(k, 10))
    found = found.where(F.col("rank") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct("text", "filename").alias("d"))))
    return found.groupBy("query_id").agg(F.transform(ranked, lambda r: r["d"]).alias("docs"))


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    generate: Generator,
    system: str,
    score: Scorer | None = None,
    top_k: int | None = None,
    max_steps: int = 3,
    parity: bool = False,
    **search,
) -> DataFrame:
    """(query_id, route, answer, reason, attempts) for every question.

    A change of style is confirmed and a question about the conversation answered from its history, without retrieval.
    Questions routed to retrieval are answered from their context and checked; those that fail the
    check are asked again with a longer query, at most ``max_steps`` times (five at most), all of them together in
    one pass per step. A retry changes the query text only, never the access filter.
    """
    steps = max(1, min(5, max_steps))
    ensure_checkpoint_dir(questions.sparkSession)
    staged = routed(questions, parity).checkpoint()
    solved = calc.calculate(staged.where("route = 'math'"), "question").select(
        "query_id", "route", F.coalesce("result", F.lit(fixed.MSG_NO_SOURCE)).alias("answer"),
        F.coalesce("error", F.lit("ok")).alias("reason"), F.lit(1).alias("attempts"),
    )
    fixed_reply = (
        F.when(F.col("route") == "social", routing.social_reply(F.col("question")))
        .when(F.col("route") == "unclear", routing.clarification(F.col("question")))
    )
    replied = staged.where(F.col("route").isin("social", "unclear")).select(
        "query_id", "route", fixed_reply.alias("answer"), F.lit("ok").alias("reason"), F.lit(1).alias("attempts")
    )
    compared = calc.compare(staged.where("route = 'comparison'"), "question").select(
        "query_id", "route",
        calc.comparison_answer(*[F.col(c) for c in ("left", "op", "right", "relation", "verdict")]).alias("answer"),
        F.lit("ok").alias("reason"), F.lit(1).alias("attempts"),
    )
    summed = calc.calculate_all(staged.where("route = 'multi_math'"), "question").select(
        "query_id", "route",
        F.array_join(F.transform("results", lambda r: F.concat_ws(" = ", r["expression"], r["result"])), "; ").alias("answer"),
        F.lit("ok").alias("reason"), F.lit(1).alias("attempts"),
    )
    # Both are answered from the conversation alone; the model drafts, fixed texts stand in where it has nothing to say.
    request = F.when(F.col("route") == "style", F.concat(F.lit(fixed.STYLE_CONFIRM_REQUEST), "style")).otherwise(
        F.concat("question", F.lit(fixed.RECALL_REQUEST))
    )
    talk = staged.where(F.col("route").isin("style", "recall"))
    bare = prompt.chat_messages(F.lit(system), F.array().cast("array<struct<text:string,filename:string>>"), request, F.col("history"))
    drafted = talk.withColumn("_draft", guard.validate_output(generate(prompt.flat_prompt(bare))))
    spoken = F.when(F.col("route") == "style", routing.style_reply(F.col("_draft"), F.col("style"))).otherwise(
        routing.recall_reply(F.col("_draft"), F.col("history"))
    )
    recalled = drafted.select("query_id", "route", spoken.alias("answer"), F.lit("ok").alias("reason"), F.lit(1).alias("attempts"))
    done = solved.unionByName(replied).unionByName(compared).unionByName(summed).unionByName(recalled)
    open_ = staged.where(F.col("route") == "retrieve")
    for attempt in range(steps):
        asked = open_.withColumn("query", routing.retry_query(F.col("query"), F.col("question"), F.lit(attempt)))
        context = retrieve_context(asked, chunks, top_k, score, parity=parity, **search)
        ready = asked.join(context, "query_id", "left")
        messages = prompt.chat_messages(F.lit(system), F.col("docs"), F.col("question"), F.col("history"))
        drafted = ready.withColumn("answer", guard.validate_output(generate(prompt.flat_prompt(messages)))).withColumn(
            "_check", routing.self_check(F.col("question"), F.col("answer"), F.transform("docs", lambda d: d["text"]))
        ).checkpoint()
        good = F.col("_check.sufficient") | F.lit(attempt + 1 >= steps)
        settled = drafted.where(good).select(
            "query_id", "route", "answer", F.col("_check.reason").alias("reason"), F.lit(attempt + 1).alias("attempts")
        )
        done = done.unionByName(settled)
        open_ = drafted.where(~good).drop("docs", "answer", "_check")
        if attempt + 1 < steps and open_.isEmpty():
            break
    return done
