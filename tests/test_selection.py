import math
import random

import pytest

from corpusmill.operators import evaluation, selection


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(3)


def same(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and (x == y or (math.isnan(x) and math.isnan(y)))) for x, y in zip(a, b))


@pytest.mark.parametrize("kind", ["even", "heavy", "ties", "one", "far"])
def test_values_at_every_kind_of_position(spark, kind, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 8)
    rng = random.Random(3)
    values = {
        "even": [rng.random() for _ in range(500)],
        "heavy": [math.exp(rng.gauss(0, 30)) for _ in range(500)],
        "ties": [rng.choice([1.0, 1.0, 1.0, 2.0, -5.5]) for _ in range(500)],
        "one": [7.25],
        "far": [-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, 1.0] * 20,
    }[kind] + [float("inf"), float("-inf"), float("nan"), float("nan")]
    ordered = sorted((v for v in values if not math.isnan(v))) + [float("nan")] * 2
    n = len(values)
    at = sorted({-1, 0, 1, n // 4, (n - 1) // 2, n // 2, round(n * 0.95), n - 4, n - 3, n - 1, n} - {p for p in (-2,)})
    got = selection.values_at(frame(spark, [*values, None]), "x", lambda count: at if count == n else [])
    assert same(got, [ordered[p] if 0 <= p < n else None for p in at])


def test_no_value_and_few_scans(spark, monkeypatch):
    assert selection.values_at(frame(spark, [None, None]), "x", lambda n: [0, n]) == [None, None]
    assert tuple(evaluation.latency_stats(frame(spark, [None]), "x").first()) == (0.0, 0.0, 0.0, 0)
    jobs = []
    bins = selection._bin
    monkeypatch.setattr(selection, "_bin", lambda *a: jobs.append(1) or bins(*a))
    values = [math.exp(random.Random(i).gauss(0, 2)) for i in range(5000)]
    got = selection.values_at(frame(spark, values), "x", lambda n: [n // 2])
    assert got == [sorted(values)[2500]] and len(jobs) <= 2


def test_latency_rules(spark):
    # numpy-like interpolated median; nearest rank of 95 per cent with halves to even
    for values in ([3.0, 1.0], [1.0, 2.0, 3.0], list(map(float, range(1, 12))), [5.0]):
        row = evaluation.latency_stats(frame(spark, values), "x").first()
        v = sorted(values)
        assert row.p50_ms == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        assert row.p95_ms == v[min(len(v) - 1, round((len(v) - 1) * 0.95))] and row.n == len(v)
