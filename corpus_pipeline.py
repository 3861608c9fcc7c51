"""From raw documents to packed training sequences: five stages, each one operator applied to all that its predecessor kept.

``STAGES`` lists them by name; a stage takes (spark, docs, sf_dir) and returns a frame, which is
written and read again as the next stage's documents. All but the last return the columns of ``documents``.

* language: documents whose language the classifier rejects go.
* exact: of equal texts the longest form stays.
* near: of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest id stays.
* secrets: every secret is replaced by a mark, and the character count is taken anew; no document goes.
* packing: the remaining texts become pieces of sequences of 2048 tokens.

Null texts have no language and go in the first stage, so later stages never see one. Documents with
a null id pass the near stage, as they cannot stand for a group. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import exactdedup, langid, nearcopies, packing, secrets
from corpusmill.llm.common import carried, stored, table

#: No SQL can express the trained classifier of the first stage; tests compare with plain programs.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return carried(docs, lambda rows: langid.identify(rows, model).where("not rejected"), {"doc_id": "doc_id", "text": "text"})


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.without_near_copies(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = carried(docs, lambda rows: secrets.redacted(secrets.secret_spans(rows)), {"doc_id": "doc_id", "text": "text"})
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("secrets", secret),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
