"""Indexes that queries share: built once per session and state of the input files, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import pivotknn, postings
from corpusmill.session import ensure_checkpoint_dir

_BUILT: dict[tuple, str] = {}


def state_of(rows: DataFrame) -> tuple:
    """Number and digest of the files (path, size, time of change) behind a frame; reads no column."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first())


def _built(spark: SparkSession, rows: DataFrame, kind: str, names: tuple, build) -> str:
    """Folder of an index of ``rows`` (read from files); built anew when a file has changed."""
    key = (spark.sparkContext.applicationId, kind, state_of(rows), names)
    if key not in _BUILT:
        folder = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        build(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _BUILT[key] = folder
    return _BUILT[key]


def lexical_index(spark: SparkSession, docs: DataFrame, scope: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    names = (doc_id, text, *(scope or []))
    return _built(spark, docs, "postings", names, lambda folder: postings.build_index(docs, folder, doc_id, text, scope))


def vector_index(spark: SparkSession, rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> str:
    return _built(spark, rows, "pivots", (vec_id, embedding), lambda folder: pivotknn.build_index(rows, folder, vec_id, embedding))
