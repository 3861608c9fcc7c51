import numpy as np
import pytest

from corpusmill.operators import knn
from corpusmill.operators import pivotknn as P

SCHEMA = "vec_id long, embedding array<float>"


def table(seed, clusters=20, each=60, dim=8, spread=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        base = rng.normal(size=dim)
        rows += [(base + rng.normal(size=dim) * spread) * rng.choice([0.5, 1, 4]) for _ in range(each)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "vec_id", "distance", "rank").collect())


@pytest.mark.parametrize("n, head", [(5, 50), (1, 1), (100, 10), (5000, 10)])
def test_equals_the_scan_and_skips_groups(spark, tmp_path, monkeypatch, n, head):
    monkeypatch.setattr(P, "HEAD", head)
    rows = table(n)
    rows += [(2000 + i, rows[3][1]) for i in range(40)]  # copies: ties by id
    rows += [(3000, [0.0] * 8), (3001, None), (3002, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = spark.createDataFrame([(q, rows[q * 37][1]) for q in range(20)] + [(99, [-1.0] * 8)], "query_id long, embedding array<float>")
    folder = f"file:{tmp_path}/i"
    P.build_index(df, folder, pivots=20)
    got, share = P.search(spark, folder, asked, n)
    good = df.where("vec_id < 3000")
    assert found(got) == found(knn.knn(good, asked, n))
    if n <= 5:
        assert share < 0.5


def test_text_ids_empty_table_and_no_query(spark, tmp_path):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    P.build_index(df, f"file:{tmp_path}/t")
    assert [r.vec_id for r in P.search(spark, f"file:{tmp_path}/t", asked, 2)[0].orderBy("rank").collect()] == ["a", "b"]
    assert P.search(spark, f"file:{tmp_path}/t", asked.limit(0), 2)[0].count() == 0
    P.build_index(df.limit(0), f"file:{tmp_path}/e")
    assert P.search(spark, f"file:{tmp_path}/e", asked, 2)[0].count() == 0
