"""Each stage of the pipeline against a plain program on what the stage before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import langid, sharding
from tests.conftest import DATA
from tests.llm.test_native import SPACE, plain_groups, plain_spans
from tests.llm.test_nearcopies import plain_stay
from tests.llm.test_packing import judge, names


def redacted(text):
    spans, covered = plain_spans(text), set()
    for s, _, e in spans:
        covered |= set(range(s, e))
    marks, last = set(), -1
    for s, _, e in spans:
        if s >= last:
            marks.add(s)
        last = max(last, e)
    return "".join(("[SECRET]" if i in marks else "") + ("" if i in covered else c) for i, c in enumerate(text))


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "secrets", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [
        (9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, "日本語の文章です。これは別の言語です。", "en", "s", 19),
        (9004, docs.first().text, "en", "s", 1), (9005, docs.first().text.replace(" ", "  "), "en", "s", 1),
        (9006, "The token = abcdefgh of the thing is here and there", "en", "s", 40),
        (9006, "The token = abcdefgh of the thing is here and there", "en", "s", 40),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, DATA)
        if name == "packing":
            assert judge(names(out), dict(before)) < 0.03
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs_after = spark.read.parquet(str(tmp_path / name))
        after = kept[name] = sorted(tuple(r) for r in docs_after.select("doc_id", "text").collect())
        if name == "language":
            said = {r.doc_id: r.rejected for r in langid.identify(docs, langid.fit(docs)).collect()}
            assert after == sorted(r for r in before if not said[r[0]])
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert {9001, 9002, 9003} <= gone and len(gone) <= 5
        elif name == "exact":
            stay = {(i, t) for (i, t), g in zip(before, plain_groups(before)) if g[3]}
            assert after == sorted(stay)
            assert len({SPACE.sub("", t) for _, t in after}) == len(after)
        elif name == "near":
            assert after == plain_stay([(i, t, None) for i, t in before])
        else:
            assert after == sorted((i, redacted(t)) for i, t in before)
            assert all(r.n_chars == len(r.text) for r in docs_after.collect())
            assert (9006, "The [SECRET] of the thing is here and there") in after
        docs = docs_after


def test_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, DATA)
        assert empty_out.count() == 0


#: Names that the stages use themselves, and names that differ from these or from the documents' by nothing but case.
CLASHES = (
    "_id _text _n _norm _digest _salt _key _stay _d _s _doc _rules _ends _before _found0 _between _whole _judged _steps _heads "
    "_own _rest _slot _shard _at Slot SHARD id digest n keys key a b x y set component node score lang_pred rejected doc row "
    "secret_spans spans start rule end kind task nr p Rejected weird.name"
).split()


def test_extra_columns_keep_names_and_values(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = [c for c in dict.fromkeys(CLASHES) if c not in ("Rejected", "rejected")] + ["Rejected"]
    wide = docs.select("doc_id", "text", *(F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in names), "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = {r.doc_id: r.text for r in stage(spark, docs, DATA).select("doc_id", "text").collect()}
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns
        rows = [r.asDict() for r in out.collect()]
        assert {r["doc_id"]: r["text"] for r in rows} == plain and len(rows) == len(plain)
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in names)
    placed = sharding.shard_rows(wide).collect()
    kept = [c for c in names if c.lower() not in ("slot", "shard")]
    assert all(r.asDict()[c] == f"{c}-{r.doc_id}" for r in placed for c in kept)
    assert {(r.doc_id, r.slot, r.shard) for r in placed} == {(r.doc_id, r.slot, r.shard) for r in sharding.shard_rows(docs).collect()}
