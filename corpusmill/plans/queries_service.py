"""Service-log, session and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluation, service
from corpusmill.plans.queries_retrieval import BM25_GLOBAL, lexical_topk
from corpusmill.plans.tables import documents, events, messages, questions, table


def _log(spark, folder):
    kind = F.col("event_type")
    return events(spark, folder).select(
        "ts",
        F.col("user_id").alias("user"),
        F.when(kind != "view", kind).alias("category"),
        F.col("value").alias("latency"),
        (F.get_json_object("props", "$.k").cast("long") % 5 == 0).alias("no_source"),
        (kind == "click").alias("cached"),
        (F.col("event_id") % 3 == 0).alias("stream"),
    )


def chat_metrics(spark, folder):
    return service.chat_metrics(_log(spark, folder))


def metrics_by_category(spark, folder):
    return service.requests_by_category(_log(spark, folder))


def latency_percentiles(spark, folder):
    out = evaluation.latency_stats(events(spark, folder), "value")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")], "n")


def _requests(spark, folder):
    return events(spark, folder).select(
        F.col("event_id").alias("request_id"), "ts", F.col("user_id").alias("user")
    )


def daily_quota(spark, folder):
    out = service.daily_quota(_requests(spark, folder), limit=2)
    return out.withColumn("day", F.col("day").cast("string"))


def quota_admitted(spark, folder):
    out = service.admitted_requests(_requests(spark, folder), limit=2)
    return out.select("user", F.col("day").cast("string").alias("day"), "request_id", F.col("nth").cast("long").alias("nth"))


def rate_limit(spark, folder):
    rows = events(spark, folder).select(
        service.identity(F.col("user_id").cast("string"), F.lit(None).cast("string")).alias("identity"),
        service.seconds(F.col("ts")).alias("t"),
        F.col("event_id").alias("request_id"),
    )
    return service.rate_limit(rows, limit=1, window=6 * 3600.0).select(
        "identity", "request_id", "admitted"
    )


def _messages(spark, folder):
    return messages(spark, folder).select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


def _sessions(spark, folder):
    seen = events(spark, folder).groupBy(F.col("user_id").alias("session_id")).agg(
        F.max(service.seconds(F.col("ts"))).alias("updated_at")
    )
    return seen.withColumn("title", F.lit(None).cast("string"))


def session_list(spark, folder):
    out = service.session_list(_sessions(spark, folder), _messages(spark, folder))
    return out.withColumn("updated_at", F.round("updated_at", 3))


def session_evict(spark, folder):
    sessions = _sessions(spark, folder)
    now = sessions.agg(F.max("updated_at")).scalar()
    return service.evict_sessions(sessions, now, ttl=2 * 86_400.0, capacity=60).select("session_id", "status")


def session_state(spark, folder):
    turns = messages(spark, folder).select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        F.col("turn").cast("double").alias("t"),
        F.when(F.col("role") == "user", F.col("text")).alias("question"),
        F.when(F.col("turn") % 3 == 0, "concise").when(F.col("turn") % 3 == 1, "loud").alias("style"),
        F.when(F.col("role") == "system", F.col("text")).alias("summary"),
        F.when(F.col("turn") % 4 == 2, F.col("turn").cast("string")).alias("math_result"),
    )
    return service.session_state(turns)


def history_window(spark, folder):
    out = service.history_window(_messages(spark, folder), 4)
    return out.select("session_id", "seq", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("from_end").cast("long").alias("from_end"))


def history_trim(spark, folder):
    out = service.prepared_history(_messages(spark, folder), threshold=6, window=2, max_chars=60)
    return out.select(
        "session_id",
        F.size("history").cast("long").alias("messages"),
        F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "¶").alias("history"),
        F.coalesce("summary", F.lit("-")).alias("summary"),
    )


def eval_ranking(spark, folder):
    found = lexical_topk(spark, folder, 5)
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("_good"))
    judged = found.join(good, "doc_id", "left").select(
        "query_id", "rank", F.coalesce("_good", F.lit(False)).alias("relevant")
    )
    per_query = evaluation.ranking_metrics(judged, 5)
    return per_query.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("mrr", "prec", "recall", "ndcg")])


def eval_summary(spark, folder):
    columns = ["hit", "mrr", "prec", "recall", "ndcg"]
    out = evaluation.macro_average(eval_ranking(spark, folder), columns)
    return out.select(*[F.round(c, 5).alias(c) for c in columns])


def _answers(spark, folder):
    """Each assistant message with the message before it as its reference."""
    said = messages(spark, folder)
    before = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return said.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("answer"), "reference"
    )


def lexical_f1(spark, folder):
    out = evaluation.lexical_f1(_answers(spark, folder), ["conv_id", "turn"], "answer", "reference")
    return out.withColumn("f1", F.round("f1", 6))


def keyword_coverage(spark, folder):
    words = F.filter(F.split("reference", " "), lambda w: F.length(w) > 6)
    return _answers(spark, folder).select(
        "conv_id", "turn", F.round(evaluation.keyword_coverage(words, F.col("answer")), 6).alias("coverage")
    )


def faithfulness(spark, folder):
    return _answers(spark, folder).select(
        "conv_id", "turn", F.round(evaluation.faithfulness(F.col("answer"), F.array("reference")), 6).alias("faithful")
    )


def refusal_rate(spark, folder):
    answers = messages(spark, folder).select(
        F.when(F.col("turn") % 2 == 1, F.when(F.col("turn") == 3, F.concat(F.lit("Không tìm thấy "), "text")).otherwise(F.col("text"))).alias("answer")
    )
    return evaluation.refusal_rate(answers).withColumn("refusal_rate", F.round("refusal_rate", 6))


def smoke_summary(spark, folder):
    runs = events(spark, folder).select(
        (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("latency"),
        (F.get_json_object("props", "$.k").cast("long") % 4).alias("sources"),
        (F.col("event_id") % 3).alias("keywords_hit"),
        F.lit(2).alias("keywords"),
    )
    return evaluation.smoke_summary(runs).withColumn("latency_mean", F.round("latency_mean", 6))


ASCII = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^a-z0-9_]+'), lambda w: length(w) >= 2)"
PAIRS = """
WITH pr AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS reference
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant')"""
RANKED = BM25_GLOBAL + """,
top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM sc QUALIFY rank <= 5),
j AS (SELECT query_id, rank, coalesce(quality = 1, false) AS rel FROM top LEFT JOIN labels USING (doc_id)),
m AS (SELECT query_id, bool_or(rel) AS hit, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rel), 0), 6) AS mrr,
    round(count(*) FILTER (rel) / count(*)::DOUBLE, 6) AS prec, bool_or(rel)::INT::DOUBLE AS recall,
    round(coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rel), 0)
      / greatest(list_sum(list_transform(range(1, 1 + greatest(1, count(*) FILTER (rel))), lambda i: 1.0::DOUBLE / log2(i + 1))), 1e-9), 6) AS ndcg
  FROM j GROUP BY query_id)
"""
QUERIES = {
    "chat_metrics": chat_metrics,
    "metrics_by_category": metrics_by_category,
    "latency_percentiles": latency_percentiles,
    "daily_quota": daily_quota,
    "quota_admitted": quota_admitted,
    "rate_limit": rate_limit,
    "session_list": session_list,
    "session_evict": session_evict,
    "session_state": session_state,
    "history_window": history_window,
    "history_trim": history_trim,
    "eval_ranking": eval_ranking,
    "eval_summary": eval_summary,
    "lexical_f1": lexical_f1,
    "keyword_coverage": keyword_coverage,
    "faithfulness": faithfulness,
    "refusal_rate": refusal_rate,
    "smoke_summary": smoke_summary,
}
ORACLES = {
    "chat_metrics": """
WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events)
SELECT count(*) AS count,
  round(any_value(v[least(n - 1, floor(n * 0.5))::INT + 1]), 3) AS latency_p50,
  round(any_value(v[least(n - 1, floor(n * 0.95))::INT + 1]), 3) AS latency_p95,
  round(avg((json_extract_string(props, '$.k')::BIGINT % 5 = 0)::INT), 4) AS no_source_rate,
  round(avg((event_type = 'click')::INT), 4) AS cached_rate,
  round(avg((event_id % 3 = 0)::INT), 4) AS stream_rate
FROM events, s""",
    "metrics_by_category": """
SELECT CASE WHEN event_type = 'view' THEN 'all' ELSE event_type END AS category, count(*) AS requests FROM events GROUP BY 1""",
    "latency_percentiles": """
SELECT round(avg(value), 6) AS mean_ms, round(median(value), 6) AS p50_ms,
  round(list_sort(list(value))[least(count(*) - 1, round_even(0.95 * (count(*) - 1), 0))::INT + 1], 6) AS p95_ms, count(*) AS n
FROM events""",
    "daily_quota": """
SELECT user_id AS user, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, least(count(*), 2) AS admitted,
  greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2""",
    "quota_admitted": """
SELECT user_id AS user, strftime(ts, '%Y-%m-%d') AS day, event_id AS request_id,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS nth
FROM events QUALIFY nth <= 2""",
    # With a limit of one, the next admitted request is the first one a full window after the last.
    "rate_limit": """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id FROM events),
a AS (
  SELECT user_id, min(t) AS t FROM e GROUP BY user_id
  UNION ALL
  SELECT a.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = a.user_id AND e.t - a.t >= 21600) FROM a
  WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = a.user_id AND e.t - a.t >= 21600))
SELECT 'user:' || e.user_id AS identity, event_id AS request_id, a.t IS NOT NULL AS admitted
FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.t = e.t""",
    "session_list": """
WITH s AS (SELECT user_id AS session_id, round(max(epoch_us(ts)) / 1e6, 3) AS updated_at FROM events GROUP BY 1),
m AS (SELECT conv_id AS session_id, count(*) AS n, arg_min(left(text, 40), turn) AS title,
  list(left(text, 80) ORDER BY turn) AS texts FROM conversations GROUP BY 1)
SELECT session_id, coalesce(title, 'Cuộc trò chuyện mới') AS title,
  CASE WHEN n >= 2 THEN texts[n - 1] WHEN n = 1 THEN texts[1] ELSE '' END AS preview,
  coalesce(n // 2, 0) AS turns, updated_at
FROM s LEFT JOIN m USING (session_id)""",
    "session_evict": """
WITH s AS (SELECT user_id AS session_id, max(epoch_us(ts)) / 1e6 AS u FROM events GROUP BY 1),
x AS (SELECT *, (SELECT max(u) FROM s) - u > 172800 AS expired FROM s)
SELECT session_id, CASE WHEN expired THEN 'expired'
  WHEN row_number() OVER (PARTITION BY expired ORDER BY u DESC, session_id) <= 60 THEN 'kept' ELSE 'evicted' END AS status FROM x""",
    "session_state": """
SELECT conv_id AS session_id,
  arg_min(left(trim(text), 50), turn) FILTER (role = 'user' AND trim(text) <> '') AS title,
  arg_max(text, turn) FILTER (role = 'system') AS summary,
  CASE WHEN count(*) FILTER (turn % 3 = 0) > 0 THEN 'concise' ELSE 'formal' END AS style,
  arg_max(turn::VARCHAR, turn) FILTER (turn % 4 = 2) AS last_math_result,
  min(turn)::DOUBLE AS created_at, max(turn)::DOUBLE AS updated_at, least(count(*) * 2, 100) AS messages
FROM conversations GROUP BY 1""",
    "history_window": """
SELECT conv_id AS session_id, turn AS seq, role, md5(text) AS content_md5,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end
FROM conversations QUALIFY from_end <= 4""",
    "history_trim": """
WITH c AS (SELECT conv_id AS session_id, turn, role, trim(text, E' \\n\\t\\r') AS t FROM conversations WHERE trim(text, E' \\n\\t\\r') <> ''),
d AS (SELECT session_id, turn, role, CASE WHEN length(t) > 60 THEN left(t, 60) || '...' ELSE t END AS t,
  count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM c),
h AS (SELECT session_id, count(*) AS messages, string_agg(role || '=' || t, '¶' ORDER BY turn) AS history
  FROM d WHERE n <= 6 OR i > n - 2 GROUP BY 1),
s AS (SELECT session_id, CASE WHEN any_value(n) - 2 > 4 THEN left(string_agg(role || ': ' || left(t, 90), ' | ' ORDER BY turn), 700) ELSE '' END AS summary
  FROM d WHERE n > 6 AND i <= n - 2 AND i <= 8 GROUP BY 1)
SELECT session_id, messages, history, coalesce(summary, '-') AS summary FROM h LEFT JOIN s USING (session_id)""",
    "eval_ranking": RANKED + "SELECT * FROM m",
    "eval_summary": RANKED + """
SELECT round(avg(hit::INT), 5) AS hit, round(avg(mrr), 5) AS mrr, round(avg(prec), 5) AS prec,
  round(avg(recall), 5) AS recall, round(avg(ndcg), 5) AS ndcg FROM m""",
    "lexical_f1": PAIRS + """,
p AS (SELECT conv_id, turn, unnest(""" + ASCII.format("answer") + """) AS w FROM pr),
r AS (SELECT conv_id, turn, unnest(""" + ASCII.format("reference") + """) AS w FROM pr),
pc AS (SELECT conv_id, turn, w, count(*) AS c FROM p GROUP BY ALL), rc AS (SELECT conv_id, turn, w, count(*) AS c FROM r GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(pc.c, rc.c)) AS o FROM pc JOIN rc USING (conv_id, turn, w) GROUP BY ALL),
np AS (SELECT conv_id, turn, sum(c) AS n FROM pc GROUP BY ALL), nr AS (SELECT conv_id, turn, sum(c) AS n FROM rc GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(2 * (o / np.n::DOUBLE) * (o / nr.n::DOUBLE) / (o / np.n::DOUBLE + o / nr.n::DOUBLE), 0), 6) AS f1
FROM pr LEFT JOIN o USING (conv_id, turn) LEFT JOIN np USING (conv_id, turn) LEFT JOIN nr USING (conv_id, turn)""",
    "keyword_coverage": PAIRS + """,
k AS (SELECT *, list_filter(string_split(reference, ' '), lambda w: length(w) > 6) AS ks FROM pr)
SELECT conv_id, turn, round(CASE WHEN len(ks) = 0 THEN 0 ELSE len(list_filter(ks,
  lambda w: contains(strip_accents(lower(answer)), strip_accents(lower(w))))) / len(ks)::DOUBLE END, 6) AS coverage FROM k""",
    "faithfulness": PAIRS + """,
s AS (SELECT conv_id, turn, reference, unnest(list_filter(regexp_split_to_array(answer, '[.?!;\\n]+'), lambda s: length(trim(s, E' \\n\\t\\r')) > 5)) AS s FROM pr),
w AS (SELECT conv_id, turn, list_distinct(""" + ASCII.format("s") + """) AS sw, list_distinct(""" + ASCII.format("reference") + """) AS rw FROM s),
f AS (SELECT conv_id, turn, avg((len(sw) > 0 AND len(list_intersect(sw, rw)) / len(sw)::DOUBLE >= 0.4)::INT) AS f FROM w GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(f, 0), 6) AS faithful FROM pr LEFT JOIN f USING (conv_id, turn)""",
    "refusal_rate": """
SELECT count(*) AS n, round(avg(CASE WHEN turn % 2 = 1 THEN (turn = 3)::INT END), 6) AS refusal_rate FROM conversations""",
    "smoke_summary": """
SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok_n,
  round(avg(value) FILTER (event_type <> 'error'), 6) AS latency_mean, max(value) FILTER (event_type <> 'error') AS latency_max,
  count(*) FILTER (event_type <> 'error' AND json_extract_string(props, '$.k')::BIGINT % 4 = 0) AS no_source,
  count(*) FILTER (event_type <> 'error' AND event_id % 3 = 2) AS all_keywords,
  count(*) FILTER (event_type = 'error') = 0
    AND count(*) FILTER (event_type <> 'error' AND json_extract_string(props, '$.k')::BIGINT % 4 = 0) / count(*) FILTER (event_type <> 'error')::DOUBLE <= 0.4 AS passed
FROM events""",
}
