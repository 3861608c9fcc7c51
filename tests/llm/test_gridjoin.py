import numpy as np

from corpusmill.llm import gridjoin as G
from tests.conftest import DATA


def plain(rows, threshold):
    """rows: (id, vector, label) -> {position: (n_links, component)} by comparing everything with everything."""
    good = [
        r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
        for r in rows
    ]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - reach:
                reach.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in reach]
        out.append((rows[i][0], len(links[i]), None if None in ids else min(ids)))
    return out


def result(df, **more):
    key = lambda t: tuple((x is None, x) for x in t)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in G.near_vectors(df, **more).collect()), key=key), key


def test_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    monkeypatch.setattr(G, "LEAF", 4)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(25):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 14)):
            v = base + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.25])
            rows.append((len(rows), [float(x) for x in v * rng.choice([1, 3])], int(c % 3)))
    rows += [
        (1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0] * 7 + [None], 1),
        (1004, rows[0][1], None), (1005, [float("inf")] + [1.0] * 7, 0), (None, rows[0][1], 0),
    ]
    df = spark.createDataFrame([(*r, 9, "n") for r in rows], "vec_id long, embedding array<double>, label int, n long, rep string")
    got, key = result(df.repartition(3), threshold=0.93)
    assert got == sorted(plain(rows, 0.93), key=key)
    kept = {r.vec_id: r.kept for r in G.near_vectors(df).collect()}
    assert kept[1000] and kept[None]


def test_each_length_is_joined(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.001, 0.0], 1), (6, [2.0], 1), (7, [3.0], 1)]
    for width in (2, 5, 16):
        for _ in range(60):
            v = rng.normal(size=width) + np.array([4] + [0] * (width - 1))
            rows.append((len(rows) + 1, [float(x) for x in v], int(rng.integers(0, 2))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got, key = result(df)
    assert got == sorted(plain(rows, 0.93), key=key)
    assert {i: c for i, _, c in got}[5] == 4


def test_pairs_of_blocks_are_formed_once_and_only_if_near(spark):
    """Many blocks of one label: all pairs within epsilon, each once."""
    rng = np.random.default_rng(5)
    boxes = [(f"b{i:03d}", "l", sorted(map(float, c)), sorted(map(float, c + rng.random(4) * 0.3))) for i, c in enumerate(rng.uniform(-1, 1, (150, 4)))]
    boxes = [(n, label, lo, [max(a, b) for a, b in zip(lo, hi)]) for n, label, lo, hi in boxes]
    df = spark.createDataFrame(boxes, "block string, label string, lo array<double>, hi array<double>")
    got = sorted(tuple(r) for r in G._pairs(df, 0.374, 3).collect())
    gap = lambda a, b: sum(max(0.0, x - q, p - y) ** 2 for x, y, p, q in zip(a[2], a[3], b[2], b[3]))
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] <= b[0] and gap(a, b) <= (0.374 + G.SLACK) ** 2)
    assert got == want and len(want) < 150 * 151 / 3


def test_lengths_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [2.0, 0.0], 1), (5, [-1.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, _ = result(df)
    assert got == [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 3, 1), (5, 0, 5)]
    assert G.near_vectors(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in G.near_vectors(nothing).collect()] == [(1, 0, 1, True)]


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got, key = result(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    assert got == sorted(plain(rows, 0.93), key=key)
