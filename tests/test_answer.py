from pyspark.sql import functions as F

from corpusmill.plans import answer

SCHEMA = "query_id long, question string, history array<struct<role:string,content:string>>, embedding array<float>"


def chunks(spark):
    rows = [
        (1, "Điều kiện xét học bổng loại giỏi của học viên", "quy_che", "a.pdf", None, [1.0, 0.0]),
        (2, "Thông báo lịch nghỉ lễ của toàn trường", "thong_bao", "b.pdf", None, [0.0, 1.0]),
    ]
    return spark.createDataFrame(rows, "id long, text string, category string, filename string, session_id string, embedding array<float>")


def test_routes_and_grounded_answer(spark):
    q = spark.createDataFrame(
        [(1, "Điều kiện xét học bổng loại giỏi?", None, [1.0, 0.0]), (2, "3 cộng 4", None, [1.0, 0.0]),
         (3, "xin chào", None, [1.0, 0.0]), (4, "2,5 lớn hơn 3 không?", None, [1.0, 0.0])], SCHEMA)
    echo = lambda p: F.concat(F.lit("[1] "), F.regexp_extract(p, r"\[1\] (.*?) \(Nguồn", 1))
    out = {r.query_id: r for r in answer.answer_questions(q, chunks(spark), echo, "sys", lambda a, t: F.lit(0.5)).collect()}
    assert (out[1].route, out[1].reason, out[1].attempts) == ("retrieve", "ok", 1)
    assert out[1].answer == "[1] Điều kiện xét học bổng loại giỏi của học viên"
    assert (out[2].route, out[2].answer) == ("math", "7")
    assert out[3].route == "social" and out[3].answer.startswith("Xin chào")
    assert out[4].route == "comparison" and out[4].answer.startswith("Sai")


def test_insufficient_answers_are_retried_within_the_same_rights(spark):
    q = spark.createDataFrame([(1, "Điều kiện xét học bổng loại giỏi?", None, [1.0, 0.0])], SCHEMA)
    out = answer.answer_questions(q, chunks(spark), lambda p: F.rpad(F.lit("x"), 400, "x"), "sys", max_steps=2, allowed=["quy_che"]).collect()
    assert [(r.reason, r.attempts) for r in out] == [("missing_citation", 2)]
    denied = answer.answer_questions(q, chunks(spark), lambda p: F.lit("ngắn"), "sys", max_steps=1, category="quy_che", allowed=["thong_bao"]).collect()
    assert [r.reason for r in denied] == ["no_context"]


def test_no_question_is_lost_beyond_the_step_limit(spark):
    q = spark.createDataFrame([(1, "Điều kiện xét học bổng loại giỏi?", None, [1.0, 0.0])], SCHEMA)
    out = answer.answer_questions(q, chunks(spark), lambda p: F.rpad(F.lit("x"), 400, "x"), "sys", max_steps=7).collect()
    assert [(r.reason, r.attempts) for r in out] == [("missing_citation", 5)]


def test_style_and_recall_are_answered_from_the_conversation(spark):
    history = [{"role": "user", "content": "Học phí bao nhiêu?"}, {"role": "assistant", "content": "Không rõ."}, {"role": "user", "content": "Khi nào nghỉ lễ?"}]
    q = spark.createDataFrame(
        [(1, "trả lời ngắn gọn", None, [1.0, 0.0]), (2, "câu hỏi đầu tiên của tôi là gì", history, [1.0, 0.0])], SCHEMA)
    out = {r.query_id: r for r in answer.answer_questions(q, chunks(spark), lambda p: F.lit("Không đủ nguồn"), "sys").collect()}
    assert out[1].route == "style" and out[1].answer.startswith("Đã đổi sang phong cách concise.")
    assert out[2].route == "recall"
    assert out[2].answer == 'Các câu hỏi bạn đã hỏi trong phiên này:\n1. Học phí bao nhiêu?\n2. Khi nào nghỉ lễ?\n\nCâu đầu tiên là: "Học phí bao nhiêu?"'
    said = {r.query_id: r.answer for r in answer.answer_questions(q, chunks(spark), lambda p: F.lit("Phong cách mới đây"), "sys").collect()}
    assert said == {1: "Phong cách mới đây", 2: "Phong cách mới đây"}
