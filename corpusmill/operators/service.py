"""Service state as tables: request log metrics, quotas, rate limits, sessions, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import fixed
from corpusmill.functions.text import strip
from corpusmill.operators.bm25 import rank_within
from corpusmill.operators.replay import piecewise_replay
from corpusmill.operators.selection import values_at


def seconds(ts: Column) -> Column:
    """Timestamp to epoch seconds with its fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


# --- request log -------------------------------------------------------------------------------------


def chat_metrics(log: DataFrame, tail: int | None = None) -> DataFrame:
    """count, latency_p50, latency_p95 and the no-source, cached and stream rates of a request log.

    ``tail`` keeps the latest rows only (by ``ts``), which is a bounded top-k.
    """
    rows = log.orderBy(F.desc("ts")).limit(tail) if tail else log
    p50, p95 = values_at(rows, "latency", lambda n: [min(n - 1, int(n * share)) for share in (0.5, 0.95)])

    def rate(flag: str) -> Column:
        return F.round(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")), 4).alias(f"{flag}_rate")

    base = rows.agg(F.count(F.lit(1)).alias("count"), rate("no_source"), rate("cached"), rate("stream"))
    return base.select(
        "count", F.round(F.lit(p50).cast("double"), 3).alias("latency_p50"), F.round(F.lit(p95).cast("double"), 3).alias("latency_p95"),
        "no_source_rate", "cached_rate", "stream_rate",
    )


def requests_by_category(log: DataFrame) -> DataFrame:
    """Requests per category; requests without one count as 'all'."""
    name = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("all"))
    return log.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("requests"))


# --- quota and rate limit ----------------------------------------------------------------------------


def daily_quota(requests: DataFrame, limit: int = fixed.CHAT_DAILY_LIMIT) -> DataFrame:
    """(user, day, requests, admitted, rejected): the first ``limit`` requests of a day are admitted."""
    per_day = requests.groupBy("user", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    admitted = F.least(F.col("requests"), F.lit(limit).cast("long"))
    return per_day.withColumn("admitted", admitted).withColumn("rejected", F.col("requests") - F.col("admitted"))


def admitted_requests(requests: DataFrame, limit: int = fixed.CHAT_DAILY_LIMIT, tie: str = "request_id") -> DataFrame:
    """The admitted requests themselves; the group limit runs before the shuffle."""
    days = requests.withColumn("day", F.to_date("ts"))
    return rank_within(days, limit, ["user", "day"], [F.asc("ts"), F.asc(tie)], "nth")


def identity(user: Column, ip: Column) -> Column:
    named = (user != "") & (user != "anonymous")
    return F.when(named, F.concat(F.lit("user:"), user)).otherwise(
        F.concat(F.lit("ip:"), F.coalesce(ip, F.lit("unknown")))
    )


def rate_limit(
    requests: DataFrame, limit: int = fixed.RATE_LIMIT_MAX, window: float = fixed.RATE_LIMIT_WINDOW, tie: str = "request_id", pieces: int | None = None
) -> DataFrame:
    """(identity, t, request_id, admitted) under a sliding log that records admitted requests only.

    ``t`` is in epoch seconds. What is kept of an identity is at most ``limit`` timestamps.
    """

    def verdict(recent: list[float], now: float, _) -> bool:
        while recent and now - recent[0] >= window:
            recent.pop(0)
        free = len(recent) < limit
        if free:
            recent.append(now)
        return free

    def matters(recent: list[float], now: float) -> list[float]:
        return [t for t in recent if now - t < window]

    return piecewise_replay(requests.select("identity", "t", tie), "identity", ["t", tie], verdict, matters, "admitted", pieces)


def cache_key(question: Column, category: Column, top_k: Column, style: Column, allowed: Column) -> Column:
    """Key of an answer: equal questions of callers with the same rights share it."""
    blank = F.lit("")
    rights = F.when(
        F.coalesce(F.size(allowed), F.lit(0)) > 0, F.array_join(F.array_sort(allowed), "|")
    ).otherwise("*")
    k = F.when(top_k != 0, top_k.cast("string"))
    text = F.concat_ws(
        "|", strip(F.coalesce(question, blank)), F.coalesce(category, blank), F.coalesce(k, blank),
        F.coalesce(style, blank), rights,
    )
    return F.sha2(text, 256)


# --- sessions ----------------------------------------------------------------------------------------


def session_state(turns: DataFrame, valid_styles: list[str] = fixed.STYLES) -> DataFrame:
    """Fold question/answer turns (session_id, seq, t, question, style, summary, math_result) to sessions.

    The title is the first question, once; summary, style and last result keep the latest given value.
    """

    def latest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))

    style = F.when(F.col("style").isin(valid_styles), F.col("style"))
    asked = F.when(strip(F.col("question")) != "", F.col("seq"))
    return turns.groupBy("session_id").agg(
        F.min_by(F.substring(strip(F.col("question")), 1, 50), asked).alias("title"),
        latest(F.nullif(F.col("summary"), F.lit(""))).alias("summary"),
        F.coalesce(latest(style), F.lit(fixed.DEFAULT_STYLE)).alias("style"),
        latest(F.col("math_result")).alias("last_math_result"),
        F.min("t").alias("created_at"),
        F.max("t").alias("updated_at"),
        F.least(F.count(F.lit(1)) * 2, F.lit(fixed.STORED_HISTORY).cast("long")).alias("messages"),
    )


def history_window(messages: DataFrame, n: int = fixed.CONVERSATION_WINDOW) -> DataFrame:
    """The last ``n`` messages of every session, numbered from the end."""
    return rank_within(messages, n, ["session_id"], [F.desc("seq")], "from_end")


def prepared_history(
    messages: DataFrame,
    threshold: int = fixed.SUMMARY_THRESHOLD,
    window: int = fixed.CONVERSATION_WINDOW,
    max_chars: int = fixed.HISTORY_CHARS,
) -> DataFrame:
    """(session_id, history, summary): recent messages as they are, older ones condensed.

    Up to ``threshold`` messages all are kept. Beyond it the last ``window`` stay and the opening of
    the rest becomes the summary (the fallback used when no language model is given).
    """
    text = strip(F.coalesce(F.col("content"), F.lit("")))
    short = F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))).otherwise(text)
    role = F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("user")
    clean = messages.where(text != "").select("session_id", "seq", role.alias("role"), short.alias("content"))
    counts = clean.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    keep = max(threshold, window)
    tail = rank_within(clean, keep, ["session_id"], [F.desc("seq")], "_back").join(counts, "session_id")
    tail = tail.where((F.col("_n") <= threshold) | (F.col("_back") <= window))
    message = F.struct("role", "content")
    history = tail.groupBy("session_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", message.alias("m")))), lambda x: x["m"]
        ).alias("history")
    )
    head = rank_within(clean, 8, ["session_id"], [F.asc("seq")], "_front").join(counts, "session_id")
    head = head.where((F.col("_n") > threshold) & (F.col("_front") <= F.col("_n") - window))
    line = F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, 90))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), " | "
    )
    old = counts.where(F.col("_n") > threshold).withColumn("_long", F.col("_n") - window > 4).select("session_id", "_long")
    summary = head.groupBy("session_id").agg(F.substring(joined, 1, 700).alias("_s"))
    summary = summary.join(old, "session_id").select(
        "session_id", F.when(F.col("_long"), F.col("_s")).otherwise("").alias("summary")
    )
    return history.join(summary, "session_id", "left")


def session_list(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, title, preview, turns, updated_at) of every session."""
    counted = messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.substring("content", 1, 40), "seq").alias("_opening"),
    )
    narrow = messages.select("session_id", "seq", F.substring("content", 1, 80).alias("_p"))
    last = rank_within(narrow, 2, ["session_id"], [F.desc("seq")], "_back").groupBy("session_id").agg(
        F.max_by("_p", "_back").alias("preview")
    )
    facts = counted.join(last, "session_id")
    return sessions.join(facts, "session_id", "left").select(
        "session_id",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), "_opening", F.lit("Cuộc trò chuyện mới")).alias("title"),
        F.coalesce("preview", F.lit("")).alias("preview"),
        F.coalesce(F.floor(F.col("_n") / 2), F.lit(0)).cast("long").alias("turns"),
        "updated_at",
    )


def evict_sessions(
    sessions: DataFrame, now: Column, ttl: float = fixed.SESSION_TTL_SECONDS, capacity: int = fixed.MAX_SESSIONS
) -> DataFrame:
    """Mark each session kept, expired (idle longer than ``ttl``) or evicted (beyond ``capacity``)."""
    expired = now - F.col("updated_at") > F.lit(float(ttl))
    marked = sessions.withColumn("_expired", expired)
    newest = marked.where(~F.col("_expired")).orderBy(F.desc("updated_at"), F.asc("session_id")).limit(capacity)
    kept = newest.select("session_id", F.lit(True).alias("_kept"))
    status = F.when(F.col("_expired"), "expired").when(F.col("_kept"), "kept").otherwise("evicted")
    return marked.join(kept, "session_id", "left").withColumn("status", status).drop("_expired", "_kept")


# --- users, tokens, uploads --------------------------------------------------------------------------


def valid_tokens(tokens: DataFrame, users: DataFrame, now: float) -> DataFrame:
    """Tokens that have not expired and whose user exists, with that user's rights."""
    live = tokens.where(F.col("exp") >= F.lit(now))
    rights = users.select("username", "is_admin", F.coalesce("categories", F.array(F.lit("*"))).alias("categories"))
    return live.join(rights, "username").select("token", "username", "is_admin", "categories")


def orphan_uploads(uploads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Upload folders whose session no longer exists."""
    return uploads.join(sessions.select("session_id"), "session_id", "left_anti")


def upload_bytes(uploads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bytes stored per owner over all their sessions."""
    owned = sessions.where(F.col("owner").isNotNull()).select("session_id", F.col("owner").alias("username"))
    return uploads.join(owned, "session_id").groupBy("username").agg(F.sum("size").alias("bytes"))


def upload_problem(filename: Column, size: Column, head: Column, files_in_session: Column, user_bytes: Column) -> Column:
    """Reason to refuse an upload, or null: suffix, size, count, content signature, user quota."""
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))
    is_text = suffix.isin(".txt", ".md", ".csv", ".log")
    return (
        F.when(~suffix.isin(fixed.UPLOAD_SUFFIXES), "suffix")
        .when(size > fixed.MAX_UPLOAD_BYTES, "size")
        .when(files_in_session >= fixed.MAX_UPLOADS_PER_SESSION, "count")
        .when((suffix == ".pdf") & (F.hex(F.substring(head, 1, 5)) != "255044462D"), "signature")
        .when((suffix == ".docx") & (F.hex(F.substring(head, 1, 4)) != "504B0304"), "signature")
        .when(is_text & F.try_validate_utf8(F.substring(head, 1, 16).cast("string")).isNull(), "signature")
        .when(user_bytes + size > fixed.MAX_UPLOAD_MB_PER_USER * 1024 * 1024, "quota")
    )


def upload_name(filename: Column) -> Column:
    return F.regexp_replace(filename, r"[^A-Za-z0-9._\-() ]", "_")


def newest_backups(backups: DataFrame, keep: int, scope: list[str], stamp: str = "stamp") -> DataFrame:
    """Backups to keep: the newest ``keep`` of each scope."""
    return rank_within(backups, keep, scope, [F.desc(stamp)], "age")
