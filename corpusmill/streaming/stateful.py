"""Keyed state over request streams: rate limit, daily quota, session state.

Each identity's state is small and bounded; Spark keeps it in the state store of the partition that
owns the key, so nothing is held in one process. With ``expire`` a key's state goes when its time to live is
over without a new row. That is for queries that run on: one with the availableNow trigger would wait for the
last time to live to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill import fixed
from corpusmill.session import ship_package


#: Days after which the state of a user without requests goes, with ``expire`` and no number of days given.
IDLE_DAYS = 40


def _ordered(batches: Iterator[pd.DataFrame], order: list[str], state: GroupState) -> pd.DataFrame | None:
    """All rows of a key in this micro-batch, in order; None (and no state any more) if the key's time to live is over.

    Arrow may hand over a key's rows in several pieces, so they are put together before they are ordered.
    """
    if state.hasTimedOut:
        state.remove()
        return None
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


def _timeout(expire: bool) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout


def _keep(state: GroupState, milliseconds: int, expire: bool) -> None:
    if expire:
        state.setTimeoutDuration(milliseconds)


def rate_limit_stream(
    requests: DataFrame, limit: int = fixed.RATE_LIMIT_MAX, window: float = fixed.RATE_LIMIT_WINDOW, expire: bool = False
) -> DataFrame:
    """(identity, request_id, t, admitted) of a stream of (identity, request_id, t)."""
    ship_package(requests.sparkSession)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = _ordered(batches, ["t", "request_id"], state)
        if rows is None:
            return
        verdicts = []
        for now in rows["t"]:
            recent = [t for t in recent if now - t < window]
            verdicts.append(len(recent) < limit)
            if verdicts[-1]:
                recent.append(now)
        state.update((recent,))
        _keep(state, int(window * 1000) + 1, expire)
        yield rows.assign(admitted=verdicts)[["identity", "request_id", "t", "admitted"]]

    return requests.select("identity", "request_id", "t").groupBy("identity").applyInPandasWithState(
        decide, "identity string, request_id long, t double, admitted boolean", "recent array<double>", "append",
        _timeout(expire),
    )


def daily_quota_stream(
    requests: DataFrame, limit: int = fixed.CHAT_DAILY_LIMIT, expire: bool = False, kept_days: int | None = None
) -> DataFrame:
    """(user, request_id, day, admitted) of a stream of (user, request_id, day); ``day`` is a date text.

    Every day's count is kept, one small entry per user and day, so late requests are judged as in the batch form. With
    ``kept_days`` only the latest days of a user are, and requests of a day before these are refused.
    """
    ship_package(requests.sparkSession)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, counts = state.get if state.exists else ([], [])
        used = dict(zip(days, counts))
        rows = _ordered(batches, ["day", "request_id"], state)
        if rows is None:
            return
        verdicts = []
        for day in rows["day"]:
            # A day that fell out of the state had its quota once; nothing of it can be admitted any more.
            forgotten = kept_days is not None and len(used) >= kept_days and day not in used and day < min(used)
            verdicts.append(not forgotten and used.get(day, 0) < limit)
            if not forgotten:
                used[day] = used.get(day, 0) + int(verdicts[-1])
            if kept_days is not None and len(used) > kept_days:
                del used[min(used)]
        state.update((list(used), list(used.values())))
        _keep(state, (kept_days or IDLE_DAYS) * 86_400_000, expire)
        yield rows.assign(admitted=verdicts)[["user", "request_id", "day", "admitted"]]

    return requests.select("user", "request_id", "day").groupBy("user").applyInPandasWithState(
        decide, "user string, request_id long, day string, admitted boolean", "days array<string>, used array<int>", "append",
        _timeout(expire),
    )


def session_stream(turns: DataFrame, expire: bool = False) -> DataFrame:
    """Latest session row per change, from a stream of (session_id, seq, t, question, style, summary, math_result)."""
    ship_package(turns.sparkSession)
    fields = "title string, summary string, style string, last_math_result string, created_at double, updated_at double, messages int"

    def append(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        title, summary, style, result, created, updated, count = (
            state.get if state.exists else (None, None, fixed.DEFAULT_STYLE, None, None, None, 0)
        )
        rows = _ordered(batches, ["seq"], state)
        if rows is None:
            return
        for question in rows["question"]:
            if not title and isinstance(question, str) and question.strip():
                title = question.strip()[:50]
        last = lambda column, good: next((v for v in reversed(rows[column].tolist()) if good(v)), None)
        summary = last("summary", lambda v: isinstance(v, str) and v) or summary
        style = last("style", lambda v: v in fixed.STYLES) or style
        found = last("math_result", lambda v: isinstance(v, str))
        result = result if found is None else found
        created = float(rows["t"].iloc[0]) if created is None else created
        updated = max(float(rows["t"].max()), float("-inf") if updated is None else updated)
        count = min(count + 2 * len(rows), fixed.STORED_HISTORY)
        _keep(state, fixed.SESSION_TTL_SECONDS * 1000, expire)
        state.update((title, summary, style, result, created, updated, int(count)))
        yield pd.DataFrame(
            [[key[0], title, summary, style, result, created, updated, count]],
            columns=["session_id", "title", "summary", "style", "last_math_result", "created_at", "updated_at", "messages"],
        )

    return turns.groupBy("session_id").applyInPandasWithState(
        append, "session_id string, " + fields, fields, "update", _timeout(expire)
    )
