import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.functions import chunking as C
from corpusmill.operators import chunks as K


def pack(text, low, high):
    """Sentence packing written as plain loops, for comparison."""
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if len(sentences) < 2:
        return [s[:high] for s in sentences if len(s) >= 20]

    def fold(parts, fits):
        out = []
        for p in parts:
            if out and fits(out[-1], p):
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    parts = fold(sentences, lambda a, b: len(a) + len(b) + 1 <= high)
    if len(parts) > 1:
        parts = fold(parts, lambda a, b: min(len(a), len(b)) < low and len(a) + len(b) + 1 <= high)
        if len(parts) > 1 and len(parts[-1]) < low and len(parts[-2]) + len(parts[-1]) + 1 <= high:
            parts[-2:] = [" ".join(parts[-2:])]
    good = [p for p in parts if len(p) >= low] or [p for p in parts if len(p) >= 20]
    return good or ([text.strip()[:high]] if len(text.strip()) >= 20 else [])


def random_texts():
    rng = random.Random(7)
    texts = ["", "Short.", "One sentence that is long enough to keep.", "x" * 2000, "A. B. C.", "Ngắn. " * 10]
    for _ in range(40):
        n = rng.randrange(1, 40)
        texts.append(" ".join("w" * rng.choice([1, 5, 30, 150, 700]) + rng.choice([".", "!", ",", "?"]) for _ in range(n)))
    return texts


@pytest.mark.parametrize("low,high", [(200, 1200), (30, 100)])
def test_packing_matches_plain_loops(spark, low, high):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", C.pack_sentences(F.col("t"), low, high).alias("c")).collect()}
    assert got == {i: pack(t, low, high) for i, t in enumerate(texts)}


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t"))).first()[0]


def test_sections(spark):
    long_line = "Điều 7. " + "nội dung " * 20
    text = "Mở đầu\nChương I\nĐiều 1. Phạm vi\nDòng một\n\nDòng hai\n" + long_line + "\nĐiều 9. Trống"
    got = [(s.heading, s.body) for s in one(spark, text, C.split_sections)]
    assert got == [
        ("", "Mở đầu"),
        ("Điều 1. Phạm vi", "Dòng một\n\nDòng hai"),
        ("Điều 7.", long_line[len("Điều 7. "):].strip()),
    ]
    assert [(s.heading, s.body) for s in one(spark, " chỉ có nội dung ", C.split_sections)] == [("", "chỉ có nội dung")]
    assert [(s.heading, s.body) for s in one(spark, "Chương I\nMục 2", C.split_sections)] == [("", "Chương I\nMục 2")]


def numbered(spark, body):
    units = one(spark, body, lambda c: C.split_numbered(F.lit("Điều 2"), c))
    return units and [(u.heading, u.text) for u in units]


def test_numbered_clauses(spark):
    assert numbered(spark, "không đánh số gì cả trong đoạn này") is None
    assert numbered(spark, "Lời dẫn đủ dài cho một đoạn\n1. Khoản thứ nhất của điều này\n2. ngắn") == [
        ("Điều 2", "Lời dẫn đủ dài cho một đoạn"), ("Điều 2", "Khoản thứ nhất của điều này"),
    ]
    with_items = "1. Đối với sinh viên\n1.1. Phải đeo thẻ khi đến trường\ntiếp theo\n1.2 Mặc áo có cổ"
    line = "1. Đối với sinh viên"
    assert numbered(spark, with_items) == [
        (f"Điều 2 | {line}", "1.1. Phải đeo thẻ khi đến trường\ntiếp theo\n1.2 Mặc áo có cổ"),
        (f"Điều 2 | {line} | 1.1.", f"{line} Phải đeo thẻ khi đến trường\ntiếp theo"),
        (f"Điều 2 | {line} | 1.2.", f"{line} Mặc áo có cổ"),
    ]
    assert numbered(spark, "1.1. Phải đeo thẻ khi đến trường\n1.2. ngắn") == [("Điều 2 | 1.1.", "Phải đeo thẻ khi đến trường")]


def test_contextual_chunks_carry_heading_and_stay_bounded(spark):
    body = " ".join(f"Câu số {i} " + " ".join(f"từ{i * 7 + j}" for j in range(16)) + "." for i in range(60))
    df = spark.createDataFrame([("Điều 4. Học tập\n" + body, "quy_che")], "t string, cat string")
    chunks = C.contextual_chunks(df, "t", category=F.col("cat")).first().chunks
    assert len(chunks) > 2 and all(c.startswith("[quy_che] | Điều 4. Học tập:\n") and len(c) <= 1200 for c in chunks)
    assert set(re.findall(r"Câu số \d+", " ".join(chunks))) <= set(re.findall(r"Câu số \d+", body))


def test_overlap_repeats_the_last_sentence_once(spark):
    chunks = ["Một. Hai.", "Ba. Bốn.", "Bốn. Năm.", "x" * 1239]
    df = spark.createDataFrame([(chunks,)], "c array<string>")
    got = df.select(C.add_overlap(F.col("c"), 1, 1200)).first()[0]
    assert got == ["Một. Hai.", "Hai. Ba. Bốn.", "Bốn. Năm.", "x" * 1239]


def test_breaks_follow_sentence_vectors(spark):
    text = " ".join(f"Sentence number {i} with some more words in it." for i in range(6))
    vectors = [[1.0, 0.0]] * 3 + [[0.0, 1.0]] * 3
    df = spark.createDataFrame([(text, vectors)], "t string, v array<array<double>>")
    got = df.select(C.pack_by_meaning(F.col("t"), F.col("v"), 20, 160)).first()[0]
    assert len(got) == 2 and got[1].startswith("Sentence number 3")


def test_short_text_rule_for_uploads_and_tables(spark):
    rec = {"source": "/u/a.txt", "filename": "a.txt", "rec_no": 0, "text": "Ghi chú ngắn.", "page": 0, "kind": "txt", "block_type": "text"}
    table = {
        "source": "/u/b.docx", "filename": "b.docx", "rec_no": 1, "text": "x", "page": 0, "kind": "docx_table", "block_type": "table",
        "table_data": {"table_index": 0, "headers": ["Tên", "Điểm"], "rows": [["Tên", "Điểm"], ["An", "9"], ["Bình", "8"]], "page": 0},
    }
    parent = {"source": "/u/b.docx", "filename": "b.docx", "rec_no": 0, "text": "Bảng điểm môn học", "page": 0, "kind": "docx", "block_type": "text"}
    df = spark.createDataFrame([rec, table, parent], schema.RECORD)
    got = {r.filename: r for r in K.upload_chunks(df, "s1").collect()}
    assert got["a.txt"].id == "s1-a.txt-0-0" and got["a.txt"].chunk_mode == "uploaded_fallback"
    assert got["b.docx"].text == (
        "[Bối cảnh trang 0]\nBảng điểm môn học\n\n[BẢNG - b.docx trang 0]\nTên | Điểm\n--- | ---\nAn | 9\nBình | 8"
    )
    assert got["b.docx"].has_table and got["b.docx"].category == "uploaded"


def test_chunk_numbers_are_dense_after_duplicates_go(spark):
    paragraph = " ".join(f"Nội dung thứ {i} của tài liệu này rất quan trọng cho học viên." for i in range(5))
    rows = [
        {"source": "/c/x.txt", "filename": "x.txt", "category": "quy_che", "subcategory": "", "rec_no": i, "text": t, "page": i, "kind": "txt", "block_type": "text"}
        for i, t in enumerate([paragraph, paragraph + " ", "Khác hẳn: " + "từ ngữ riêng biệt không giống đoạn trên chút nào. " * 6])
    ]
    out = K.build_chunks(spark.createDataFrame(rows, schema.RECORD)).orderBy("chunk_index").collect()
    assert [(r.id, r.chunk_index) for r in out] == [("x.txt-0-0", 0), ("x.txt-2-1", 1)]


def test_chunking_is_dealt_by_the_size_of_its_input(spark, tmp_path):
    """A task's share stays the same when the table grows, so a worker's memory does and cores stay even."""
    dice = random.Random(3)
    rows = [(i, " ".join(f"{dice.getrandbits(256):x}" for _ in range(150)) + ".") for i in range(1500)]
    spark.createDataFrame(rows, "id long, t string").repartition(2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    stored = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    lots = -(-stored // (2 * 1024 * 1024))
    assert lots > spark.sparkContext.defaultParallelism
    for made in (C.fast_chunks(df, "t"), C.contextual_chunks(df, "t")):
        assert made.rdd.getNumPartitions() >= lots


def test_overlong_parts_are_cut_between_sentences(spark):
    parts = ["Short one.", "One two three. Four five six! Seven eight nine? Ten.", "x" * 40, "Y" * 40 + ". Z."]
    df = spark.createDataFrame([(parts,), ([],), (["a" * 30],)], "p array<string>")
    got = [r[0] for r in df.select(C._split_long(F.col("p"), 30)).collect()]
    assert got == [
        ["Short one.", "One two three. Four five six!", "Seven eight nine? Ten.", "x" * 40, "Y" * 40 + ".", "Z."], [], ["a" * 30],
    ]


def test_a_text_that_is_not_packed_is_kept_without_words(spark):
    """One sentence, or parts that are all too short, are returned before duplicates are looked for; packed parts are not."""
    texts = ["=" * 30, "-" * 1500, "=" * 19, "." + " " * 30 + "!", ". . . . . . . . . . . .", "*** *** *** ***. " + "+" * 1300, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.chunks for r in C.fast_chunks(df, "t").collect()}
    assert [got[i] or [] for i in range(len(texts))] == [["=" * 30], ["-" * 1200], [], ["." + " " * 30 + "!"], [], [], [], []]


def test_a_text_is_cleaned_once(spark, monkeypatch):
    cleaned = spark.sparkContext.accumulator(0)

    def count(text):
        cleaned.add(1)
        return text

    monkeypatch.setattr(K, "clean_text", lambda c: F.udf(count, "string")(c))
    rows = [
        {"source": f"/c/{i}.txt", "filename": f"{i}.txt", "rec_no": 0, "text": f"Văn bản số {i} " + "có nội dung riêng của nó. " * 12, "page": 0, "kind": "txt", "block_type": "text"}
        for i in range(20)
    ]
    assert K.build_chunks(spark.createDataFrame(rows, schema.RECORD)).count() == 20
    assert cleaned.value == 20
