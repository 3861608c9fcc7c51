import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import access, fusion, knn
from corpusmill.plans import retrieval


def test_where_cases():
    assert access.where_column(None) is None
    assert "IN" in str(access.where_column({"category": ["a", "b"]})).upper()
    with pytest.raises(ValueError):
        access.where_column(["category"])


def test_filters_on_rows(spark):
    df = spark.createDataFrame(
        [("a", "s1", '{"page":"3","flag":true}'), ("b", None, '{"page":"4"}'), ("c", None, "{}")],
        "category string, session_id string, metadata string",
    )

    def count(where):
        return access.apply_where(df, where).count()

    assert count({"category": []}) == 0
    assert count({"category": ["a", "b"]}) == 2
    assert count({"category": None}) == 0
    assert count({"$and": [{"category": "b"}, {"page": 4}]}) == 1
    assert count({"flag": True}) == 0  # text of JSON true is 'true'


def test_access_resolution():
    assert access.resolve_categories(None, None) == (True, None)
    assert access.resolve_categories("quy_che", ["*"]) == (True, "quy_che")
    assert access.resolve_categories("quy_che", ["thong_bao"])[0] is False
    assert access.resolve_categories(None, ["thong_bao", "quy_che"]) == (True, ["thong_bao", "quy_che"])
    assert access.resolve_categories(None, [])[0] is False
    assert access.resolve_categories(None, [], parity=True) == (True, None)


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id long, key string, score double, rank int")


def test_reciprocal_ranks_put_the_shared_text_first(spark):
    out = fusion.order_fused(
        fusion.fuse_rrf(ranking(spark, [(1, "a", 0.1, 1), (1, "b", 0.2, 2)]), ranking(spark, [(1, "b", 5.0, 1), (1, "c", 3.0, 2)])), 5
    ).orderBy("rank").collect()
    assert [(r.key, r.score) for r in out] == [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]


def test_weighted_fusion_and_single_branch(spark):
    vec = ranking(spark, [(1, "a", 0.1, 1), (1, "b", 0.5, 2), (2, "z", 1.4, 1)])
    lex = ranking(spark, [(1, "b", 9.0, 1), (1, "c", 1.0, 2), (3, "q", 2.0, 1)])
    got = {(r.query_id, r.key): (r.score, r.score_kind) for r in fusion.fuse_weighted(vec, lex).collect()}
    assert got[(1, "a")] == (0.4, "fused") and got[(1, "b")] == (0.6, "fused") and got[(1, "c")] == (0.0, "fused")
    assert got[(2, "z")] == (1.4, "distance") and got[(3, "q")] == (2.0, "bm25")


def test_all_equal_branch_is_one(spark):
    out = fusion.min_max(ranking(spark, [(1, "a", 1.2, 1), (1, "b", 1.9, 2)]), True).collect()
    assert [r.norm for r in out] == [1.0, 1.0]


def test_knn_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    table, queries = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(7, 8))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    x = table.astype(float)
    dist = np.round(1 - (x @ queries.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None]), 6)
    want = {(j, int(i)) for j in range(7) for i in np.lexsort((np.arange(300), dist[:, j]))[:5]}
    for options in ({}, {"max_floats": 8, "fragment_rows": 40, "block_rows": 3}):
        got = {(r.query_id, r.vec_id) for r in knn.knn(t, q, 5, **options).collect()}
        assert got == want
    assert knn.knn(t, q, 0).count() == 0


def chunk_table(spark):
    rows = [
        (1, "quy chế đào tạo học bổng", "quy_che", "a", None, [1.0, 0.0]),
        (2, "thông báo nghỉ lễ", "thong_bao", "b", None, [0.9, 0.1]),
        (3, "tài liệu riêng của phiên", "uploaded", "c", "s1", [1.0, 0.01]),
        (4, "học bổng toàn phần", "quy_che", "d", None, [0.0, 1.0]),
    ]
    return spark.createDataFrame(rows, "id long, text string, category string, filename string, session_id string, embedding array<float>")


def asked(spark):
    return spark.createDataFrame([(1, "học bổng", [1.0, 0.0])], "query_id long, query string, embedding array<float>")


def test_sessions_are_isolated(spark):
    chunks, q = chunk_table(spark), asked(spark)
    assert 3 not in [r.id for r in retrieval.vector_search(chunks, q, 4).collect()]
    mine = retrieval.vector_search(chunks, q, 3, session_id="s1").orderBy("rank").collect()
    assert mine[0].id == 3
    assert 3 not in [r.id for r in retrieval.vector_search(chunks, q, 4, session_id="s2").collect()]


def test_denied_category_gives_nothing(spark):
    chunks, q = chunk_table(spark), asked(spark)
    for search in (retrieval.vector_search, retrieval.lexical_search, retrieval.hybrid_search):
        assert search(chunks, q, 3, category="quy_che", allowed=["thong_bao"]).count() == 0
    found = retrieval.hybrid_search(chunks, q, 3, allowed=["quy_che"]).collect()
    assert {r.category for r in found} == {"quy_che"}


def test_bm25_statistics_follow_the_filter(spark):
    chunks, q = chunk_table(spark), asked(spark)
    everywhere = {r.id: r.score for r in retrieval.lexical_search(chunks, q, 5).collect()}
    inside = {r.id: r.score for r in retrieval.lexical_search(chunks, q, 5, category="quy_che").collect()}
    assert set(everywhere) == set(inside) == {1, 4} and everywhere != inside


def test_pinned_chunk_comes_first_once(spark):
    chunks, q = chunk_table(spark), asked(spark)
    found = retrieval.lexical_search(chunks, q, 2)
    out = retrieval.pin_rows(found, q, chunks, [("học bổng", ["nghỉ lễ"])]).orderBy("rank").collect()
    assert [r.id for r in out][0] == 2 and len(out) == 3
    hidden = retrieval.pin_rows(found, q, chunks, [("học bổng", ["nghỉ lễ"])], allowed=["quy_che"])
    assert hidden.count() == 2


def test_lots_follow_the_corpus_not_the_session(spark, tmp_path):
    """What a task of the scan holds must not grow with the corpus: more of it makes more partitions, also behind a join."""
    from corpusmill.session import deal

    spark.range(200_000).selectExpr("id", "uuid() AS u").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    wide = deal(rows, "id", rows, size // 20).rdd.getNumPartitions()
    joined = rows.join(rows.withColumnRenamed("u", "v"), "id", "left")
    assert 20 <= wide <= 22 and 40 <= deal(joined, "id", joined, size // 20).rdd.getNumPartitions() <= 44
    assert deal(rows, "id", rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
