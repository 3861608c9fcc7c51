import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.plans import build
from corpusmill.sources import buckettable, files, manifest, store, vectortable
from corpusmill.streaming import ingest, stateful

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, paragraphs, table):
    def p(t):
        return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"

    grid = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    body = f"{p(paragraphs[0])}<w:tbl>{grid}</w:tbl>{p(paragraphs[1])}"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "data"
    (root / "quy_che" / "2024" / "k1").mkdir(parents=True)
    text = " ".join(f"Câu {i} của văn bản quy định về việc học tập tại trường." for i in range(40))
    (root / "quy_che" / "2024" / "k1" / "a.TXT").write_text(text, encoding="utf-8")
    (root / "quy_che" / "old.txt").write_bytes("Quyết định cũ về ".encode() + b"\xe9\xe8" + b" ghi chu dai " * 30)
    (root / "quy_che" / "~$a.txt").write_text("tạm")
    (root / "quy_che" / "blank.txt").write_text("  \n ")
    (root / "note.md").write_text("không đọc")
    docx(root / "quy_che" / "b.docx", ["Đoạn một của tài liệu", "Đoạn hai"], [["Tên", "Điểm"], ["", ""], ["An", "9"]])
    (root / "quy_che" / "bad.docx").write_bytes(b"not a zip")
    return str(root)


def test_records_of_files(spark, corpus):
    got = {(r.filename, r.rec_no): r for r in files.load_records(spark, corpus).collect()}
    assert set(got) == {("a.TXT", 0), ("old.txt", 0), ("b.docx", 0), ("b.docx", 1)}
    a = got[("a.TXT", 0)]
    assert (a.category, a.subcategory, a.kind) == ("quy_che", "2024/k1", "txt")
    assert "é" in got[("old.txt", 0)].text or "\u0301" in got[("old.txt", 0)].text
    assert got[("b.docx", 0)].text == "Đoạn một của tài liệu\nĐoạn hai"
    t = got[("b.docx", 1)]
    assert t.text == "Tên | Điểm\nAn | 9" and t.table_data.headers == ["Tên", "Điểm"] and len(t.table_data.rows) == 2


def test_bad_file_is_reported_alone(spark, corpus):
    scanned = files.scan_files(spark, corpus)
    good, bad = files.extracted_records(scanned, files.read_docx, [".docx"])
    assert good.count() == 2 and [r.path.endswith("bad.docx") for r in bad.collect()] == [True]


def test_no_file_goes_without_trace(spark, corpus, tmp_path):
    import pathlib

    root = pathlib.Path(corpus)
    (root / "quy_che" / "scan.pdf").write_bytes(b"%PDF")
    told = {r.path.rsplit("/", 1)[-1]: r.error for r in files.read_corpus(spark, corpus)[1].collect()}
    assert set(told) == {"bad.docx", "scan.pdf", "blank.txt"} and told["bad.docx"].startswith("BadZipFile")
    counts = {r.path.rsplit("/", 1)[-1]: (r.chunks > 0, r.error is None) for r in build.clean_corpus(spark, corpus, str(tmp_path / "none"), dry_run=True).collect()}
    assert counts == {n: (True, True) for n in ("a.TXT", "old.txt", "b.docx")} | {n: (False, False) for n in told}
    assert not (tmp_path / "none").exists()


def test_page_rules(spark):
    def block(x0, y0, x1, text, kind=0):
        return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "text": text, "block_type": kind}

    two = [block(0, 30, 90, "L2"), block(0, 10, 90, "L1"), block(300, 50, 400, "R3"), block(300, 10, 400, "R1"), block(300, 31, 400, "R2"), block(0, 0, 9, "img", 1)]
    table = {"table_index": 0, "headers": ["a", "b"], "rows": [["a", "b"], ["1", "2"]], "bbox": [0.0], "page": 1, "text": "a | b " * 8}
    images = [{"image_index": i, "width": w, "height": h} for i, (w, h) in enumerate([(200, 200), (50, 50), (1700, 2400)])]
    pages = [
        ("/p.pdf", {"page": 1, "width": 400.0, "plain_text": "", "blocks": two, "tables": [table], "images": images}),
        ("/p.pdf", {"page": 2, "width": 400.0, "plain_text": "ít chữ", "ocr_text": "nhận dạng", "blocks": [], "images": images}),
        ("/p.pdf", {"page": 3, "width": 400.0, "plain_text": " "}),
    ]
    from pyspark.sql import types as T

    df = spark.createDataFrame(pages, T.StructType([T.StructField("path", T.StringType()), T.StructField("pg", schema.PAGE)]))
    out = files.page_records(df.select("path", "pg.*")).orderBy("rec_no").collect()
    assert [(r.page, r.kind) for r in out] == [(1, "pdf"), (1, "pdf_table"), (1, "pdf_figure"), (2, "pdf_scan")]
    assert out[0].text == "L1\nL2\nR1\nR2\nR3" and out[3].text == "nhận dạng"
    assert out[2].image_info.visual_type == "image"


def embed(text):
    return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))


def test_clean_then_index_incrementally(spark, corpus, tmp_path):
    path, root = str(tmp_path / "store"), str(tmp_path / "vectors")
    build.clean_corpus(spark, corpus, path)
    chunks = store.load_chunks(spark, path)
    assert chunks.count() >= 3 and store.count_chunks(chunks).first().chunks == chunks.count()
    times = build.file_times(spark, corpus)
    empty = spark.createDataFrame([], schema.MANIFEST)
    table, seen = build.update_index(chunks, times, empty, vectortable.read_table(spark, root), embed, "m1")
    vectortable.commit(table, root, "v1")
    assert vectortable.read_table(spark, root).count() == chunks.count()
    manifest.save_manifest(seen, str(tmp_path / "manifest"))
    previous = manifest.load_manifest(spark, str(tmp_path / "manifest"))
    # Nothing changed: nothing is embedded, the table stays.
    current = vectortable.read_table(spark, root)
    again, seen = build.update_index(chunks, times, previous, current, lambda c: F.raise_error(F.lit("no call")), "m1")
    assert again.count() == chunks.count()
    # One source removed, an upload present: the upload stays.
    upload = current.limit(1).withColumn("id", F.lit("up")).withColumn("session_id", F.lit("s1"))
    fewer = chunks.where(~F.col("source").endswith("old.txt"))
    third, _ = build.update_index(fewer, times, previous, current.unionByName(upload), embed, "m1")
    assert third.count() == fewer.count() + 1
    rebuilt, _ = build.update_index(fewer, times, previous, current.unionByName(upload), embed, "m1", rebuild=True)
    assert rebuilt.count() == fewer.count() + 1


def test_upsert_keeps_birth_and_last_row(spark):
    def rows(data, extra=""):
        return spark.createDataFrame(data, "id string, text string, created_at timestamp" + extra)

    import datetime as dt

    old, new = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    existing = rows([("a", "old", old), ("b", "stay", old)])
    incoming = rows([("a", "x", new, 1), ("a", "y", new, 2), ("c", "z", new, 3)], ", seq int")
    got = {r.id: (r.text, r.created_at) for r in vectortable.upsert(existing, incoming, "seq").collect()}
    assert got == {"a": ("y", old), "b": ("stay", old), "c": ("z", new)}


def test_upload_pages_compare_as_text(spark):
    rows = [(str(p), "s", "f", '{"page":"%d","source":"x"}' % p, "c") for p in (9, 10)]
    df = spark.createDataFrame(rows, "id string, session_id string, filename string, metadata string, category string")
    assert vectortable.uploads_by_session(df).first().page == 9
    assert vectortable.delete_by_session(df, "s", "other").count() == 2 and vectortable.delete_by_session(df, "s").count() == 0


def test_manifest_changes_and_missing_file(spark):
    chunks = spark.createDataFrame([("a\\x",), ("b",), ("gone",), ("same",)], "source string")
    times = spark.createDataFrame([("a/x", 2.0), ("b", 1.0), ("same", 5.0)], "path string, mtime double")
    old = spark.createDataFrame([("a/x", 1.0), ("same", 5.0), ("left", 9.0)], "source string, mtime double")
    diff = manifest.manifest_diff(old, manifest.seen_sources(chunks, times))
    got = {r.source: (r.mtime, r.change) for r in diff.collect()}
    assert got == {"a/x": (2.0, "changed"), "b": (1.0, "new"), "gone": (0.0, "new"), "same": (5.0, "unchanged"), "left": (9.0, "removed")}


def test_incremental_build_of_buckets(spark, tmp_path):
    """Only buckets of changed and removed sources are rewritten; uploads stay."""
    root = str(tmp_path / "bt")

    def chunks(texts):
        return spark.createDataFrame(
            [{"id": f"{n}-0-0", "text": t, "category": "c", "subcategory": "", "filename": n, "source": n, "page": 0, "chunk_index": 0, "chunk_mode": "contextual"} for n, t in texts.items()],
            schema.CHUNK,
        )

    def times(names):
        return spark.createDataFrame([(n, t) for n, t in names.items()], "path string, mtime double")

    empty = spark.createDataFrame([], schema.MANIFEST)
    texts = {f"d{i}": f"chữ {i}" for i in range(6)}
    touched, seen = build.update_buckets(spark, root, "v1", chunks(texts), times({n: 1.0 for n in texts}), empty, embed, "m", buckets=32)
    assert {r.id: r.text for r in buckettable.read(spark, root).collect()} == {f"{n}-0-0": t for n, t in texts.items()}
    manifest.save_manifest(seen, str(tmp_path / "m1"))
    upload = buckettable.read(spark, root).where("id = 'd1-0-0'").withColumn("id", F.lit("d1-9-9")).withColumn("session_id", F.lit("s")).withColumn("_seq", F.lit(0))
    buckettable.change(spark, root, "up", upload, buckets=32)
    changed = {n: t for n, t in texts.items() if n != "d1"} | {"d2": "khác"}
    old = manifest.load_manifest(spark, str(tmp_path / "m1"))
    touched, _ = build.update_buckets(spark, root, "v2", chunks(changed), times({n: 1.0 + (n == "d2") for n in changed}), old, embed, "m", buckets=32)
    assert len(touched) <= 2
    want = {f"{n}-0-0": t for n, t in changed.items()} | {"d1-9-9": texts["d1"]}
    assert {r.id: r.text for r in buckettable.read(spark, root).collect()} == want


def test_json_metadata(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "x double")
    assert [r[0] for r in df.select(vectortable.json_safe(F.col("x"))).collect()] == [None, None, 1.5]


def run_stream(spark, tmp_path, df, transform, mode="append"):
    source, name = str(tmp_path / "in"), "out_" + str(abs(hash(str(tmp_path))))
    df.write.parquet(source)
    stream = transform(spark.readStream.schema(df.schema).parquet(source))
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streaming_rate_limit(spark, tmp_path):
    df = spark.createDataFrame([("u", i, float(t)) for i, t in enumerate([0, 1, 2, 61, 62])], "identity string, request_id long, t double")
    out = run_stream(spark, tmp_path, df, lambda s: stateful.rate_limit_stream(s, 2, 60.0))
    assert {r.request_id: r.admitted for r in out} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_streaming_quota(spark, tmp_path):
    df = spark.createDataFrame([("u", i, d) for i, d in enumerate(["d1", "d1", "d1", "d2"])], "user string, request_id long, day string")
    out = run_stream(spark, tmp_path, df, lambda s: stateful.daily_quota_stream(s, 2))
    assert {r.request_id: r.admitted for r in out} == {0: True, 1: True, 2: False, 3: True}


def test_streaming_order_does_not_depend_on_arrow_pieces(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        times = [5.0, 61.0, 0.0, 62.0, 1.0, 2.0, 63.0]
        df = spark.createDataFrame([("u", i, t) for i, t in enumerate(times)], "identity string, request_id long, t double")
        out = run_stream(spark, tmp_path, df.coalesce(1), lambda s: stateful.rate_limit_stream(s, 2, 60.0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # By time: 0, 1 admitted; 2, 5 refused; 61 (0 and 1 are gone) and 62 admitted; 63 refused.
    assert {r.t: r.admitted for r in out} == {0.0: True, 1.0: True, 2.0: False, 5.0: False, 61.0: True, 62.0: True, 63.0: False}


def test_streaming_quota_of_late_days(spark, tmp_path):
    first = [("u", 0, "d2"), ("u", 1, "d1"), ("u", 2, "d2")]
    source, name = str(tmp_path / "in"), "late_days"
    schema_ = "user string, request_id long, day string"
    out = {}
    for rows in (first, [("u", 3, "d1"), ("u", 4, "d2"), ("u", 5, "d1")]):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.daily_quota_stream(spark.readStream.schema(schema_).parquet(source), 2)
        folder = str(tmp_path / name)
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", str(tmp_path / "ck"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        out = {r.request_id: r.admitted for r in spark.read.parquet(folder).collect()}
    assert out == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_streaming_quota_equals_the_batch_form_on_old_days(spark, tmp_path):
    from corpusmill.operators import service

    days = [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in range(60)]
    asked = [("u", 3 * i + k, d) for i, d in enumerate(days) for k in range(3)]
    late = [("u", 1000 + i, d) for i, d in enumerate(days[:5])] + [("u", 2000, "2023-12-31")]
    schema_, source, folder = "user string, request_id long, day string", str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (asked, late):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.daily_quota_stream(spark.readStream.schema(schema_).parquet(source), 2)
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", str(tmp_path / "ck"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    out = {r.request_id for r in spark.read.parquet(folder).where("admitted").collect()}
    batch = spark.createDataFrame(asked + late, schema_).withColumn("ts", F.col("day").cast("timestamp"))
    assert out == {r.request_id for r in service.admitted_requests(batch, 2).collect()}
    few = run_stream(spark, tmp_path / "few", spark.createDataFrame(asked, schema_).coalesce(1), lambda s: stateful.daily_quota_stream(s, 2, kept_days=3))
    assert sum(r.admitted for r in few) == 120


def test_streaming_sessions(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", 0, 1.0, "Câu đầu tiên?", "loud", None, None), ("s", 1, 2.0, "Tiếp", "concise", "tóm", "7")],
        "session_id string, seq int, t double, question string, style string, summary string, math_result string",
    )
    row = run_stream(spark, tmp_path, df, stateful.session_stream, "update")[-1]
    assert (row.title, row.style, row.summary, row.last_math_result, row.messages) == ("Câu đầu tiên?", "concise", "tóm", "7", 4)


def test_streaming_index(spark, tmp_path):
    stored, root = str(tmp_path / "chunks"), str(tmp_path / "vt")

    def chunk(cid, text):
        return {"id": cid, "text": text, "category": "quy_che", "subcategory": "", "filename": "f", "source": "f", "page": 0, "chunk_index": 0, "chunk_mode": "contextual"}

    def arrive(build, *items):
        spark.createDataFrame(list(items), schema.CHUNK).coalesce(1).write.mode("append").parquet(stored)
        ingest.index_stream(ingest.chunk_stream(spark, stored), root, embed, "m", str(tmp_path / "ck"), build).awaitTermination(120)
        return {r.id: r.text for r in buckettable.read(spark, root).collect()}

    assert arrive("b1", chunk("f-0-0", "một")) == {"f-0-0": "một"}
    # The same source in a second batch of the same build stays whole; another build replaces it.
    assert arrive("b1", chunk("f-0-1", "hai")) == {"f-0-0": "một", "f-0-1": "hai"}
    assert arrive("b2", chunk("f-0-0", "một mới")) == {"f-0-0": "một mới"}
    # Metadata keep their types beside the build.
    told = json.loads(buckettable.read(spark, root).first().metadata)
    assert told["page"] == 0 and told["build"] == "b2" and told["embedding_dim"] > 0


def test_commit_survives_stops(spark, tmp_path):
    root = str(tmp_path / "vt")
    row = {f.name: None for f in schema.VECTOR_TABLE.fields} | {"id": "a-0-0", "text": "t", "category": "c"}
    one = spark.createDataFrame([row], schema.VECTOR_TABLE)
    # Stopped between table and pointer: reading says so, committing again finishes.
    vectortable.commit(one, root, "v1")
    import shutil

    shutil.rmtree(f"{root}/_current")
    with pytest.raises(RuntimeError):
        vectortable.read_table(spark, root)
    vectortable.commit(one, root, "v1")
    assert vectortable.read_table(spark, root).count() == 1
    # Stopped while the next version or its pointer was written: the old version is still there.
    one.write.parquet(f"{root}/v2/category=c")
    (tmp_path / "vt" / "_current" / f"{2:012d}").mkdir()
    assert vectortable.read_table(spark, root).count() == 1
    vectortable.commit(one.unionByName(one.withColumn("id", F.lit("b-0-0"))), root, "v2")
    assert vectortable.read_table(spark, root).count() == 2
    vectortable.commit(one, root, "v2")
    assert vectortable.read_table(spark, root).count() == 2


def test_search_in_an_index_with_text_ids(spark, tmp_path):
    """Chunks as they are stored go into the table, and hybrid search finds them by their own ids."""
    from corpusmill.plans import build, retrieval

    chunks = spark.createDataFrame(
        [
            {"id": f"f-{i}-0", "text": t, "category": c, "subcategory": "", "filename": "f", "source": "f", "page": i, "chunk_index": 0, "chunk_mode": "contextual"}
            for i, (t, c) in enumerate([("học bổng loại giỏi", "quy_che"), ("lịch nghỉ lễ", "thong_bao"), ("học phí kỳ này", "quy_che")])
        ],
        schema.CHUNK,
    )
    rows = build.vector_rows(chunks, embed, "m")
    vectortable.commit(rows, str(tmp_path / "vt"), "v1")
    table = vectortable.read_table(spark, str(tmp_path / "vt"))
    asked = table.where("id = 'f-0-0'").select(F.lit("q1").alias("query_id"), F.lit("học bổng").alias("query"), "embedding")
    for method in ("weighted", "rrf"):
        found = [r.id for r in retrieval.hybrid_search(table, asked, top_k=3, method=method).orderBy("rank").collect()]
        assert found[0] == "f-0-0"
    granted = retrieval.hybrid_search(table, asked, top_k=3, allowed=["thong_bao"]).collect()
    assert {r.id for r in granted} <= {"f-1-0"}
    assert retrieval.hybrid_search(table, asked, top_k=3, category="quy_che", allowed=["thong_bao"]).count() == 0
