import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import hardneg as H
from tests.conftest import DATA


def plain(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """rows: (id, vector, label), exact repetitions once; every anchor against every row, in Python integers."""
    seen, items = set(), []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in q) < 2**60 and (i, q, label) not in seen:
            seen.add((i, q, label))
            items.append((i, q, label))
    out = []
    for me in items:
        if me[0] not in anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(me[1], o[1])), o[0], o[2] == me[2]) for o in items if o is not me and len(o[1]) == len(me[1])]
        for p, pid, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(me[0], pid, r, n[1], -p, -n[0]) for r, n in enumerate(fit, 1)]
    return sorted(out)


def result(df, anchors):
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id").isin(list(anchors))).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, nr int, lot string")


def test_clusters_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_BITS", 4)
    monkeypatch.setattr(H, "BLOCK_BITS", 2)
    monkeypatch.setattr(H, "SLICE", 3)
    monkeypatch.setattr(H, "CENTROIDS", 6)
    monkeypatch.setattr(H, "HEAD", 20)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        base = rng.normal(size=6)
        for _ in range(25):
            v = base + rng.normal(size=6) * 0.6
            rows.append((len(rows), [float(x) for x in v * rng.choice([0.2, 1, 3])], int(rng.integers(0, 3))))
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 2) for i in range(60)] + [(1000, hot, 0), (1001, hot, 2)]  # copies, a repeated row, a shared id
    rows += [
        (2000, None, 1), (2001, [float("nan")] * 6, 1), (2002, [1.0] * 5 + [None], 1), (2003, rows[0][1], None), (None, rows[0][1], 1),
        (2004, [0.0] * 6, 1), (2005, [0.0] * 6, 2), (2006, [1.0, 2.0], 1), (2007, [1.0, 1.5], 1), (2008, [0.5, 1.0], 2), (2009, [1e300] * 6, 1),
        (2010, [], 1), (2011, [], 1), (2012, [], 2), (2013, [2.0**20] * 6, 1), (2014, [2.0**19] * 6, 2), (2015, [2.0**20] * 6, 1),
        (2016, [float("inf")] * 6, 1), (2017, [1.0] * 9, 7),
    ]
    anchors = {i for i, *_ in rows if i is not None and (i % 5 == 0 or i >= 2000)} | {1001, 1003}
    df = frame(spark, rows)
    want = plain(rows, anchors)
    assert len(want) > 1000 and {r[0] for r in want} >= {2006, 2010, 2013}
    assert result(df.repartition(5), anchors) == want


def test_fewer_than_asked_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.5, 0.5], 2), (4, [-1.0, 0.0], 2), (5, [1.0, 0.0], 3)]
    df = frame(spark, rows)
    assert result(df, {1, 5}) == plain(rows, {1, 5}) != []
    assert result(df, {99}) == []
    assert result(df.limit(0), {1}) == []


@pytest.mark.parametrize("same", [True, False])
def test_walk_is_certified(monkeypatch, same):
    """A walk stops early and still gives what all scores give."""
    monkeypatch.setattr(H, "STRIDE", 16)
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(4000, 3)))).astype(np.int64)
    labels, first = rng.integers(0, 2, 4000), rng.permutation(4000)
    norm = np.sqrt((x**2).sum(axis=1))
    a = np.floor(300 * (np.array([1.0, 0.2, 0.1]) + rng.normal(size=(7, 3)) * 0.05)).astype(np.int64)
    goal = [[int(v @ v)] for v in a]
    block = H.Block(np.arange(7), np.arange(7) % 2, a, goal, [[None]] * 7, same, 30, 90)
    steps = []
    scores = H._scores
    monkeypatch.setattr(H, "_scores", lambda *args: steps.append(len(args[1])) or scores(*args))
    window, score, found = H.walk(block, labels, x, norm, first, np.ones(4000, np.int64), same, 4)
    assert sum(steps) < 3000
    for w in range(7):
        s = x @ a[w]
        fit = (labels == w % 2) == same
        if not same:
            fit &= (100 * s >= 30 * goal[w][0]) & (100 * s <= 90 * goal[w][0])
        want = sorted(np.flatnonzero(fit), key=lambda i: (-s[i], first[i]))[:4]
        assert found[window == w].tolist() == want and score[window == w].tolist() == s[want].tolist()


def test_given_table(spark):
    rows = [
        (r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 and r.label is not None else r.label)
        for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ]
    got = sorted(tuple(r) for r in H.op11_hard_negatives(spark, DATA).collect())
    assert got == plain(rows, {i for i, *_ in rows if i % 100 == 0}) != []
