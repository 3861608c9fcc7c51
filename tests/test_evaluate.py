import json

from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions import routing
from corpusmill.operators import access
from corpusmill.plans import evaluate
from corpusmill.sources import vectortable


def test_golden_set_report(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(json.dumps([
        {"question": "Học bổng?", "reference": "mức học bổng giỏi", "golden_file": "quy che", "golden_keywords": ["học bổng"], "ref_keywords": ["giỏi", "khá"]},
        {"question": "Không có?", "unanswerable": True},
    ]), encoding="utf-8")
    golden = evaluate.read_golden(spark, str(path))
    found = golden.select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).select(
        "query_id", "rank", F.lit("Quy Chế.pdf").alias("filename"),
        F.when(F.col("rank") == 2, "mức HỌC BỔNG").otherwise("khác").alias("text"),
    )
    answers = golden.select(
        "query_id",
        F.when(F.col("unanswerable"), "Không tìm thấy thông tin").otherwise("mức học bổng giỏi").alias("answer"),
        F.array(F.lit("mức học bổng giỏi là")).alias("contexts"),
    )
    r = evaluate.report(golden, found, answers, 5).first()
    assert (r.n, r.n_answerable, r.hit, r.mrr, r.prec, r.recall) == (2, 1, 1.0, 0.5, 0.5, 1.0)
    assert round(r.ndcg, 6) == 0.63093 and (r.f1, r.kw, r.faith_h, r.refusal_rate) == (1.0, 0.5, 1.0, 1.0)


def test_visible_categories_keep_their_order(spark):
    df = spark.createDataFrame([(["thong_bao", "quy_che"],), (["*"],), (None,)], "c array<string>")
    got = [r[0] for r in df.select(access.ordered_categories(F.col("c"), fixed.CATEGORY_ORDER)).collect()]
    assert got == [["quy_che", "thong_bao"], fixed.CATEGORY_ORDER, fixed.CATEGORY_ORDER]


def test_evicted_sessions_lose_their_uploads(spark):
    rows = [("1", "s1", "f", '{"page":1}'), ("2", "s1", "f", '{"page":2}'), ("3", "s2", "f", '{"page":1}'), ("4", None, "f", "{}")]
    df = spark.createDataFrame(rows, "id string, session_id string, filename string, metadata string")
    left = vectortable.delete_sessions(df, spark.createDataFrame([("s2",)], "session_id string"))
    assert sorted(r.id for r in left.collect()) == ["1", "2", "4"]
    assert [(r.chunks, r.pages) for r in vectortable.upload_facts(df).orderBy("session_id").collect()] == [(2, 2), (1, 1)]


def test_social_replies(spark):
    df = spark.createDataFrame([("hello",), ("bạn là ai",), ("gì đó",)], "q string")
    got = [r[0] for r in df.select(routing.social_reply(F.col("q"), "Tôi là trợ lý.")).collect()]
    assert got[0].startswith("Xin chào") and got[1] == "Tôi là trợ lý." and got[2] == fixed.SOCIAL_OTHER
