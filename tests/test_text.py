import unicodedata

from pyspark.sql import functions as F

from corpusmill.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_clean_drops_letterhead_and_boilerplate(spark):
    raw = (
        "HỌC VIỆN KỸ THUẬT MẬT MÃ\nĐộc lập – Tự do – Hạnh phúc\nSố: 12/QĐ\nTrang 3\n  17 \n-----\n- -\n.\n"
        "Quy định – chung   về học tập (ban hành kèm theo Quyết định 5) \r\nTheo văn bản 12/QĐ-HVM\n\n\nThông báo\nThông báo mới"
    )
    assert one(spark, raw, X.clean_text) == ".\nQuy định - chung về học tập\nTheo văn bản 12\nThông báo mới"


def test_clean_of_empty_text(spark):
    assert one(spark, "", X.clean_text) == "" and one(spark, None, X.clean_text) == ""


def test_normalize_matches_definition(spark):
    assert one(spark, "  Điều_5:  x² (ABC)…  ", X.normalize_text) == "điều_5 x² abc"
    decomposed = unicodedata.normalize("NFD", "học")
    assert one(spark, decomposed, X.normalize_text) == "ho c"


def test_accents_follow_unicode_decomposition(spark):
    text = "Điều kiện học bổng – Ünïcödé Ậ ñ ß й"
    want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    assert one(spark, text, X.strip_accents) == want


def test_tokens_and_sentences(spark):
    assert one(spark, "A bb, ccc-bb!", X.tokenize) == ["bb", "ccc", "bb"]
    assert one(spark, "Điều kiện", X.ascii_tokens) == ["ieu", "kien"]
    assert one(spark, " Một. Hai!  Ba? Bốn.Năm ", X.split_sentences) == ["Một.", "Hai!", "Ba?", "Bốn.Năm"]


def test_lines_keep_inner_blank_lines_only(spark):
    assert one(spark, "a\r\n\nb c\n", X.lines) == ["a", "", "b", "c"]


def test_cleaning_of_rare_spaces_and_breaks(spark):
    texts = ["a  b", "a\u2003 \u2003b\t\tc", "x \x85\n \u2028 y", "a\r\nb\rc\x0b\x0c\x1dd", "\u3000a\xa0", "p – q—r", " \n a \n ", "a\x1fb", "(Ban hành kèm theo x) y", "z/QĐ-HVM", "/"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.clean_text(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == ["a b", "a b c", "x\ny", "a\nb\nc\nd", "a", "p - q-r", "a", "a b", "y", "z", "/"]
