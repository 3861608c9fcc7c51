import zlib

import numpy as np
import pytest

from corpusmill.llm import langid as L


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs)


def test_held_out_accuracy(docs, model):
    rows = L.identify(docs, model).where(L.held_out("doc_id")).select("doc_id", "lang", "lang_pred").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_nothing_is_learned_from_held_out_rows(spark, docs, model):
    from pyspark.sql import functions as F

    spoilt = docs.withColumn("lang", F.when(L.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    again = L.fit(spoilt)
    assert again.languages == model.languages and np.array_equal(again.table, model.table)


def test_odd_texts(spark, model):
    texts = [None, "", "  12 .!", "日本語の文章です", "the " * 200_000, "der die das und"]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].score == 0 and got[i].rejected for i in range(3))
    assert got[3].rejected and got[3].lang_pred in model.languages
    assert not got[4].rejected and not got[5].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.identify(df.limit(0), model).count() == 0


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None), (None, None, "en")], "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.languages == [] and [r.lang_pred for r in L.identify(df, model).collect()] == ["und"] * 2


def test_slices_see_the_whole_text(monkeypatch):
    text = "ab cd, ef " * 50
    whole = np.bincount(np.concatenate(list(L.buckets(text))), minlength=L.BUCKETS)
    assert whole.sum() > 1000
    monkeypatch.setattr(L, "_SLICE", 100)
    cut = np.bincount(np.concatenate(list(L.buckets(text))), minlength=L.BUCKETS)
    assert np.abs(cut - whole).sum() < 0.1 * whole.sum()


def test_a_language_left_out_is_rejected_and_clean_documents_stay(docs, model):
    from pyspark.sql import functions as F

    clean = L.identify(docs, model).where(L.held_out("doc_id"))
    lost = clean.select(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert lost <= 0.01
    less = L.fit(docs.where("lang <> 'en'"))
    assert "en" not in less.languages
    said = L.identify(docs.where("lang = 'en'"), less)
    assert said.select(F.avg(F.col("rejected").cast("int"))).first()[0] > 0.5


def test_thresholds_follow_the_size():
    size = np.array([240] * 1000 + [7000] * 1000)
    p = np.concatenate([np.linspace(0.6, 1, 1000), np.linspace(0.9, 1, 1000)])
    at, least = L.thresholds(p, size, 0.29)
    assert at.tolist() == [1, 240, 7000] and least[0] == 0.29 and 0.6 <= least[1] < 0.61 and 0.9 <= least[2] < 0.91
    assert [x.tolist() for x in L.thresholds(np.zeros(0), np.zeros(0, int), 0.5)] == [[1], [0.5]]
