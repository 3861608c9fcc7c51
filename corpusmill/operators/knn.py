"""Exact cosine nearest neighbours of a batch of query vectors.

Usual case, a bounded batch: the query matrix travels to the tasks, each task reduces its share of
the table to ``n`` rows per query with one matrix product per Arrow batch, and only those rows are
shuffled. A larger batch is cut into blocks and joined fragment by fragment (replicate join), so no
task ever holds more than one fragment and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.operators.bm25 import rank_within
from corpusmill.session import ship_package

MAX_BROADCAST_FLOATS = 8_000_000
#: Distances computed at once: 16 MB.
TILE = 1 << 21
_DIGITS = 6


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(table: np.ndarray, queries: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(table, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(1.0 - (table @ queries.T) / length, _DIGITS)


def _best(ids: np.ndarray, dist: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``n`` smallest distances (ties by id) of one query."""
    if len(dist) > 4 * n:  # ties at the cut stay in
        near = dist <= np.partition(dist, n - 1)[n - 1]
        ids, dist = ids[near], dist[near]
    order = np.lexsort((ids, dist))[:n]
    return ids[order], dist[order]


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids in their own type; text as fixed-width text, which sorts by code point."""
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(np.str_) if values.dtype == object else values


class _TopN:
    """Running best rows per query inside one task: bounded by queries x n."""

    def __init__(self, count: int, n: int):
        self.n = n
        self.rows: list[tuple[np.ndarray, np.ndarray] | None] = [None] * count

    def search(self, ids: np.ndarray, vectors: np.ndarray, wanted: np.ndarray) -> None:
        """Add a batch, in tiles of TILE distances whatever the batch and the number of queries."""
        queries = max(1, min(len(wanted), TILE // 1024))
        rows = max(1, TILE // queries)
        for q in range(0, len(wanted), queries):
            for at in range(0, len(vectors), rows):
                self._add(q, ids[at : at + rows], _distances(vectors[at : at + rows], wanted[q : q + queries]))

    def _add(self, first: int, ids: np.ndarray, dist: np.ndarray) -> None:
        for q in range(dist.shape[1]):
            column, old = dist[:, q], self.rows[first + q]
            keep = ~np.isnan(column)
            if old is not None and len(old[1]) == self.n:
                keep &= column <= old[1][-1]
            if keep.any():
                new = ids[keep], column[keep]
                if old is not None:
                    new = np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]])
                self.rows[first + q] = _best(*new, self.n)

    def table(self, query_ids: list, schema: pa.Schema) -> pa.Table:
        found = [(q, *r) for q, r in zip(query_ids, self.rows) if r is not None]
        if not found:
            return schema.empty_table()
        queries = [q for q, ids, _ in found for _ in range(len(ids))]
        ids = pa.array(np.concatenate([i for _, i, _ in found]))
        dist = pa.array(np.concatenate([d for _, _, d in found]))
        return pa.table([pa.array(queries, schema.field(0).type), ids.cast(schema.field(1).type), dist], schema=schema)


def _output(table: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("vec_id", table.schema["vec_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def _broadcast_branch(table: DataFrame, rows: list, n: int, out: T.StructType) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.asarray([r[1] for r in rows], np.float64)))
    arrow = to_arrow_schema(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, wanted = shared.value
        top = _TopN(len(query_ids), n)
        for batch in batches:
            if batch.num_rows:
                top.search(_ids(batch.column(0)), _matrix(batch.column(1)), wanted)
        yield from top.table(query_ids, arrow).to_batches()

    return table.mapInArrow(search, out)


def _replicate_branch(table: DataFrame, queries: DataFrame, n: int, out: T.StructType, fragments: int, blocks: int) -> DataFrame:
    left = table.withColumn("_f", F.pmod(F.xxhash64("vec_id"), F.lit(fragments))).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "_f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fragments - 1).cast("long")))
    )
    arrow = to_arrow_schema(out)

    def search(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        query_ids = wanted.column("query_id").to_pylist()
        top = _TopN(len(query_ids), n)
        if vectors.num_rows and query_ids:
            top.search(_ids(vectors.column("vec_id")), _matrix(vectors.column("embedding")), _matrix(wanted.column("embedding")))
        return top.table(query_ids, arrow)

    return left.groupBy("_f", "_b").cogroup(right.groupBy("_f", "_b")).applyInArrow(search, out)


def knn(
    table: DataFrame,
    queries: DataFrame,
    n: int,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    max_floats: int = MAX_BROADCAST_FLOATS,
    fragment_rows: int = 200_000,
    block_rows: int = 2_000,
) -> DataFrame:
    """(query_id, vec_id, distance, rank): the ``n`` nearest rows of ``table`` per query.

    ``queries`` has ``query_id`` and ``embedding``. Ids keep their type (numbers or text). Filter
    ``table`` first: a predicate on it reaches the scan. Exact, ties broken by id.
    """
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.where(F.size("embedding") > 0)
    wanted = queries.select("query_id", "embedding").where(F.size("embedding") > 0)
    out = _output(rows, wanted)
    if n <= 0:
        return rows.sparkSession.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())]))
    ship_package(rows.sparkSession)
    first = wanted.limit(1).collect()
    dim = len(first[0]["embedding"]) if first else 1
    bound = max(1, max_floats // max(dim, 1))
    probe = wanted.limit(bound + 1).collect()
    if not probe:
        found = rows.sparkSession.createDataFrame([], out)
    elif len(probe) <= bound:
        found = _broadcast_branch(rows, [(r[0], r[1]) for r in probe], n, out)
    else:
        fragments = max(1, -(-rows.count() // fragment_rows))
        blocks = max(1, -(-wanted.count() // block_rows))
        found = _replicate_branch(rows, wanted, n, out, fragments, blocks)
    return rank_within(found, n, ["query_id"], [F.asc("distance"), F.asc("vec_id")])


def assert_uniform_dimension(table: DataFrame, embedding: str = "embedding") -> int:
    """Dimension of the stored vectors; an error if they differ."""
    low, high = table.agg(F.min(F.size(embedding)), F.max(F.size(embedding))).first()
    if low != high:
        raise ValueError(f"vector dimension differs between rows: {low} and {high}")
    return low or 0


def models_in_use(table: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(embedding_model, rows): more than one row means vectors of different models are mixed."""
    model = F.get_json_object(F.col(metadata), "$.embedding_model")
    return table.where(model.isNotNull() & (model != "")).groupBy(model.alias("embedding_model")).agg(
        F.count(F.lit(1)).alias("rows")
    )
