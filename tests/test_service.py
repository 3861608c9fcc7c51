import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, service


def plain_log(data, limit, window):
    want, logs = {}, {}
    for u, t, i in sorted(data, key=lambda r: (r[1], r[2])):
        log = logs[u] = [x for x in logs.get(u, []) if t - x < window]
        want[i] = len(log) < limit
        if want[i]:
            log.append(t)
    return want


@pytest.mark.parametrize("limit, window, pieces", [(3, 20.0, 8), (1, 7.0, 16), (5, 400.0, 3), (2, 1.0, 1)])
def test_rate_limit_matches_sequential_log(spark, limit, window, pieces):
    rng = random.Random(4)
    users = ["hot"] * 300 + [f"cold{i % 9}" for i in range(60)] + [None] * 20
    data = [(u, round(rng.uniform(0, 400), 1), i) for i, u in enumerate(users)]  # ties in time as well
    df = spark.createDataFrame(data, "identity string, t double, request_id long").repartition(5)
    got = {r.request_id: r.admitted for r in service.rate_limit(df, limit=limit, window=window, pieces=pieces).collect()}
    want = plain_log(data, limit, window)
    assert got == want and not all(want.values())


def test_only_pieces_that_began_wrong_are_done_again(spark, monkeypatch):
    """Pauses longer than the window between the pieces: one pass is proven right."""
    from corpusmill.operators import replay

    data = [("u", 1000.0 * (i // 50) + i % 50, i) for i in range(400)]
    df = spark.createDataFrame(data, "identity string, t double, request_id long")
    starts, again = [], replay.json.loads
    monkeypatch.setattr(replay.json, "loads", lambda x: starts.append(x) or again(x))
    got = {r.request_id: r.admitted for r in service.rate_limit(df, limit=2, window=10.0, pieces=8).collect()}
    assert got == plain_log(data, 2, 10.0)
    assert sum(x.startswith("[") for x in starts) <= 16  # two passes at most, of which the second is over some pieces
    assert service.rate_limit(df.limit(0)).count() == 0


def test_entry_expires_exactly_at_the_window(spark):
    df = spark.createDataFrame([("u", 0.0, 1), ("u", 59.999, 2), ("u", 60.0, 3)], "identity string, t double, request_id long")
    got = {r.request_id: r.admitted for r in service.rate_limit(df, limit=1, window=60.0).collect()}
    assert got == {1: True, 2: False, 3: True}


@pytest.mark.parametrize("n", [1, 2, 20, 997])
def test_percentile_rules(spark, n):
    values = [random.Random(n).choice([0.5, 1.0, 2.5]) * i for i in range(n)]
    log = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "latency double, ts long").withColumn(
        "no_source", F.col("ts") % 2 == 0).withColumn("cached", F.lit(None).cast("boolean")).withColumn("stream", F.lit(True))
    s = sorted(values)
    m = service.chat_metrics(log).first()
    assert m.latency_p50 == round(s[min(n - 1, int(0.5 * n))], 3)
    assert m.latency_p95 == round(s[min(n - 1, int(0.95 * n))], 3)
    assert (m["count"], m.cached_rate, m.stream_rate) == (n, 0.0, 1.0)
    e = evaluation.latency_stats(log, "latency").first()
    assert e.p50_ms == statistics.median(values)
    assert e.p95_ms == s[min(n - 1, int(round(0.95 * (n - 1))))]


def test_metrics_tail_and_empty_log(spark):
    log = spark.createDataFrame([(float(i), i, False, False, False) for i in range(10)], "latency double, ts long, no_source boolean, cached boolean, stream boolean")
    assert service.chat_metrics(log, tail=4).first()["latency_p50"] == 8.0
    assert evaluation.latency_stats(log.limit(0), "latency").first()["p95_ms"] == 0.0


def test_ranking_metrics_by_hand(spark):
    rows = [(1, r, r in (2, 3)) for r in range(1, 6)] + [(2, 1, False), (3, 1, True)]
    got = {r.query_id: r for r in evaluation.ranking_metrics(spark.createDataFrame(rows, "query_id int, rank int, relevant boolean"), 5).collect()}
    assert (got[1].hit, got[1].mrr, got[1].prec, got[1].recall) == (True, 0.5, 0.4, 1.0)
    assert round(got[1].ndcg, 6) == round((0.6309298 + 0.5) / (1 + 0.6309298), 6)
    assert (got[2].hit, got[2].mrr, got[2].ndcg) == (False, 0.0, 0.0)
    assert got[3].ndcg == 1.0


def test_f1_and_empty_sides(spark):
    df = spark.createDataFrame([(1, "học bổng học", "hoc bong"), (2, "", "x y"), (3, "aa bb", "cc")], "i int, p string, r string")
    got = {r.i: round(r.f1, 6) for r in evaluation.lexical_f1(df, ["i"], "p", "r").collect()}
    assert got == {1: 0.8, 2: 0.0, 3: 0.0}


def test_upload_checks(spark):
    rows = [("a.pdf", 10, b"%PDF-1.7"), ("a.pdf", 10, b"nope"), ("a.docx", 10, b"PK\x03\x04"), ("a.exe", 1, b""), ("a.txt", 1, b"\xff\xfe"), ("b.txt", 1, "é".encode())]
    df = spark.createDataFrame([(n, s, bytearray(h)) for n, s, h in rows], "n string, s long, h binary")
    got = [r[0] for r in df.select(service.upload_problem(F.col("n"), F.col("s"), F.col("h"), F.lit(0), F.lit(0))).collect()]
    assert got == [None, "signature", None, "suffix", "signature", None]


def test_tokens_and_owner_rules(spark):
    tokens = spark.createDataFrame([("t1", "u", 10.0), ("t2", "u", 5.0), ("t3", "x", 99.0)], "token string, username string, exp double")
    users = spark.createDataFrame([("u", False, None)], "username string, is_admin boolean, categories array<string>")
    assert [(r.token, r.categories) for r in service.valid_tokens(tokens, users, 10.0).collect()] == [("t1", ["*"])]
