"""The stored postings index against the scan, which has its own tests."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bm25
from corpusmill.operators import postings as P


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.randrange(1, 60)))
    rows = [(i, f"c{i % 3}", text()) for i in range(n)]
    rows += [(n + i, "c1", rows[7][2]) for i in range(80)]  # copies: one score
    rows += [(n + 99, "c2", None), (n + 100, "c2", ""), (n + 101, None, "w1 w2 lonely")]
    queries = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for q in range(25)]
    queries += [(100, rows[7][2]), (101, "w0 w1 w2"), (102, "nowhere"), (103, ""), (104, None), (105, "w3 w3 w3 w4"), (106, "lonely")]
    return rows, queries


def found(df, scope):
    return sorted(tuple(r) for r in df.select("query_id", *scope, "doc_id", "score", "rank").collect())


@pytest.mark.parametrize("scope, k, bits", [([], 5, 4), (["category"], 3, 3), ([], 1000, 6), ([], 1, 12)])
def test_equals_the_scan(spark, tmp_path, scope, k, bits):
    rows, queries = corpus(k)
    docs = spark.createDataFrame(rows, "doc_id long, category string, text string").where("category is not null or not {}".format(bool(scope)))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    folder = f"file:{tmp_path}/index"
    P.build_index(docs.repartition(5), folder, scope=scope, bits=bits)
    got = found(P.search(spark, folder, asked, k, scope, bits=bits), scope)
    want = found(bm25.bm25_topk(docs.fillna("", "text"), asked.where("query is not null"), k, scope), scope)
    assert got == want and len(got) > 20


def test_text_ids_and_other_names(spark, tmp_path):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "id string, body string")
    P.build_index(docs, f"file:{tmp_path}/i", doc_id="id", text="body")
    asked = spark.createDataFrame([(1, "one")], "n long, ask string")
    rows = P.search(spark, f"file:{tmp_path}/i", asked, 5, query_id="n", query="ask").orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in rows] == [(1, "a", 1), (1, "b", 2)]


def test_each_row_is_a_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (2, None), (None, "one")], "doc_id long, text string")
    P.build_index(docs, f"file:{tmp_path}/i")
    rows = P.search(spark, f"file:{tmp_path}/i", spark.createDataFrame([(9, "one")], "query_id long, query string"), 5).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1] and rows[1].score == rows[2].score


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    P.build_index(docs, f"file:{tmp_path}/i")
    assert P.search(spark, f"file:{tmp_path}/i", spark.createDataFrame([(1, "one")], "query_id long, query string")).count() == 0


def test_blocks_below_the_threshold_are_not_fetched(spark, tmp_path, monkeypatch):
    common = "the of and to in that it is was for on are as with his they be at"
    rows = [(i, f"{common} filler{i}") for i in range(640)] + [(1000 + i, "rare gem stone " * 3) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file:{tmp_path}/i"
    P.build_index(docs, folder, bits=4)
    asked = spark.createDataFrame([(1, f"rare gem stone {common}")], "query_id long, query string")
    fetched, scored = [], P._scored
    monkeypatch.setattr(P, "_scored", lambda pairs, *a: fetched.append(pairs.count()) or scored(pairs, *a))
    got = P.search(spark, folder, asked, 5, bits=4).collect()
    assert {r.doc_id for r in got} == set(range(1000, 1005))
    assert fetched[0] == P.HEAD and fetched[1] <= 2  # of more than 40 blocks


def test_a_block_travels_once_whatever_the_number_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "LOT", 60)  # several rows of a term and block, with different documents
    rows, queries = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, category string, text string")
    folder = f"file:{tmp_path}/i"
    P.build_index(docs.repartition(3), folder, bits=6)
    stored = spark.read.parquet(f"{folder}/postings")
    assert stored.count() > stored.select("term", "block").distinct().count()
    asked = spark.createDataFrame([q for q in queries if q[1] is not None], "query_id long, query string")
    assert found(P.search(spark, folder, asked, 5, bits=6), []) == found(bm25.bm25_topk(docs.fillna("", "text"), asked, 5), [])
    weights, postings = P.weighted_terms(spark, folder, asked, [])
    weights = weights.localCheckpoint()
    pairs = P.block_bounds(weights, postings, asked, []).withColumn("floor", F.lit(0.0)).localCheckpoint()
    plan = P._scored(pairs, weights, postings, [], 5, 6)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and all("[block#" in line and "query_id" not in line for line in dealt)


def test_words_of_most_documents_score_only_documents_already_met():
    best = P.Best(2, 3, floor=5.0)
    import numpy as np

    every = np.arange(8)
    best.add(0, [(6.0, 6.0, np.array([3, 4]), np.array([1.0, 0.9])), (0.5, 0.5, every, np.ones(8))])
    assert best.take()[0].tolist() == [3, 4] and best.take()[1].tolist() == [6.5, 5.9] and best.floor == 5.9
