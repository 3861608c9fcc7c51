"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

An id is replaced by its rank among all ids of the corpus (0 is the most frequent), so most take one byte.
Two bits of a control byte tell how many bytes (1 to 4) each of four ranks has; control bytes and data
bytes are separate streams, so numpy encodes and decodes a whole file at once: control bytes index a
table of byte masks, the masks put data bytes into 32-bit words, and a table of ids undoes the ranking.

A folder of token files holds

* ``ranks``: 32-bit ids in order of rank,
* ``*.ids``: header (magic, documents, ids, data bytes), document ids (64 bits) and whether they are known (a byte), lengths (64 bits),
  control bytes, data bytes; all little-endian. A document is never cut, and a file ends after ``FILE_IDS`` ids or more,
* ``manifest`` (Parquet): name, documents, ids, bytes and number of the first id of each file.

Tasks write their files under names that no other attempt uses. What counts is the manifest, which Spark commits
with one attempt per task: files of lost or repeated attempts are never named in it, so they are never read.
Documents are in ascending order of their id over all files. Hot ids are no problem for the partitioning by range, as
check sum and row number follow in the key.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import gone_at_end, shared_folder, stored, table, text_of
from corpusmill.llm.packing import token_ids, tokenizer_path
from corpusmill.session import ship_package

END = 2
FILE_IDS = 1 << 22
MAGIC = b"rankids1"

# ---- the coding --------------------------------------------------------------------------------------------------

_CODES = np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3
#: [control byte, 4 * number in the quadruple + byte]: whether the byte is in the data stream.
_MASKS = (np.arange(4) <= _CODES[:, :, None]).reshape(256, 16)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers. Places missing in the last quadruple have code 0 and no data."""
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    four.ravel()[: len(ranks)] = codes
    control = four @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    mask = _MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[mask] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def file_bytes(docs: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    return b"".join([
        MAGIC, np.array([len(docs), len(ranks), len(data)], "<u8").tobytes(),
        np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is not None for d in docs], np.uint8).tobytes(),
        lengths.astype("<u8").tobytes(), control, data,
    ])


def file_content(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ranks of a file; raises ValueError if it is not a whole file of this format."""
    if raw[:8] != MAGIC or len(raw) < 32:
        raise ValueError("not a token file")
    n_docs, n_ids, n_data = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    sizes = [8 * n_docs, n_docs, 8 * n_docs, -(-n_ids // 4), n_data]
    at = np.cumsum([32, *sizes]).tolist()
    if len(raw) != at[-1]:
        raise ValueError("token file cut short or too long")
    docs, known, lengths, control, data = (raw[a:b] for a, b in zip(at, at[1:]))
    ids = [d if k else None for d, k in zip(np.frombuffer(docs, "<i8").tolist(), known)]
    return ids, np.frombuffer(lengths, "<u8").astype(np.int64), unpack_ranks(control, data, n_ids)


# ---- folders -----------------------------------------------------------------------------------------------------


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI as Spark names it (``file:/x``, ``hdfs://...``, ``s3a://...``)."""
    uri = folder.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, content: bytes) -> None:
    store, path = _opened(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(content)


def _get(folder: str, name: str) -> bytes:
    store, path = _opened(folder)
    with store.open_input_stream(f"{path}/{name}") as source:
        return source.read()


def encoded(docs: DataFrame, path: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, crc, n, ids (little-endian; two bytes each where all fit, else four); encoded once, stored."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, n, raw = [], [], []
            for text in batch.column(2):
                ids = token_ids(text.as_py() or "", path)
                ids[-1] = end  # the tokenizer's caller before put its own end there
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
                raw.append((ids.astype("<u2") if ids.max() <= 0xFFFF else ids).tobytes())
            cols = [batch.column(0), batch.column(1), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "crc", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "row long, doc_id long, crc long, n long, ids binary"), "zstd")


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.uint32)


def ranks_of(tokens: DataFrame) -> np.ndarray:
    """Ids in order of rank: most frequent first, ties by id. One row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.bincount(_numbers(raw.as_py(), n), minlength=len(total))
                counts[: len(total)] += total
                total = counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))], np.uint32)


def write_tokens(
    docs: DataFrame, folder: str, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS
) -> None:
    """Encode whole texts, each with the id ``end`` behind it, into token files below ``folder``.

    A null or empty text is its end id alone. Rows without an id come first; rows that repeat an id are documents
    of their own, in the order of their check sums. An empty table gives a folder without token files. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    tokens = encoded(docs, path, end, id_col, text_col)
    by_rank = ranks_of(tokens)
    _put(folder, "ranks", by_rank.astype("<u4").tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            lengths = np.array([len(h) for h in held])
            content = file_bytes(ids, lengths, ranks.value[np.concatenate(held)])
            _put(folder, name, content)
            row = (part, seq, name, len(ids), int(lengths.sum()), len(content))
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in row], ["part", "seq", "name", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(i) for i in range(3))):
                ids.append(doc.as_py())
                held.append(_numbers(raw.as_py(), n.as_py()))
                size += len(held[-1])
                if size >= file_ids:
                    yield flush()
                    seq, ids, held, size = seq + 1, [], [], 0
        if held:
            yield flush()

    key = ("doc_id", "crc", "row")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("doc_id", "n", "ids")
    files = stored(ordered.mapInArrow(run, "part long, seq long, name string, n_docs long, n_ids long, n_bytes long"))
    # First ids: sums of the parts before (one row per part), then of the files before in the part.
    before, firsts = 0, []
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        firsts.append((r.part, before))
        before += r.n
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    (
        files.join(F.broadcast(spark.createDataFrame(firsts, "part long, start long")), "part")
        .select("name", "n_docs", "n_ids", "n_bytes", start.alias("first_id"))
        .write.parquet(f"{folder}/manifest")
    )


def _documents(folder: str, by_rank: np.ndarray, name: str, first: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of each document of a file."""
    docs, lengths, ranks = file_content(_get(folder, name))
    ids = by_rank[ranks] if len(ranks) else np.zeros(0, np.uint32)
    ends = np.cumsum(lengths)
    for doc, length, at in zip(docs, lengths.tolist(), (ends - lengths).tolist()):
        yield doc, first + at, ids[at : at + length]


def read_tokens(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """One row per document of the files below ``folder``: doc_id, start (ids of all documents before it), n_tokens,
    and ids (array), or only their check sum ids_crc32 if ``digests``.

    A file is one task's work; the files of the manifest are spread over the cluster by name.
    """
    ship_package(spark)
    by_rank = spark.sparkContext.broadcast(np.frombuffer(_get(folder, "ranks"), "<u4"))  # as long as the vocabulary
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"]
    last = pa.int64() if digests else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                size = 0
                for doc, start, ids in _documents(folder, by_rank.value, name, first):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digests else ids.astype(np.int64)))
                    size += 1 if digests else len(ids)
                    if size >= 1 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [last])], names)

    manifest = spark.read.parquet(f"{folder}/manifest").select("name", "first_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "ids_crc32 long" if digests else "ids array<long>"
    return manifest.repartition(parts, "name").mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    gone_at_end(spark, folder)
    return read_tokens(spark, folder, digests=True)
