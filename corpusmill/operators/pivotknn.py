"""Exact cosine nearest neighbours over a stored index of pivots, with whole groups of rows skipped.

Index. Pivots are unit vectors chosen on a bounded sample. Every row goes to its nearest pivot and, by its
angle to it, to one of ``RINGS`` rings; a group is a (pivot, ring). The directory has one row per group: rows,
least and greatest angle. There are at most pivots x rings groups, whatever the table.

Search, for a bounded batch of queries. Angles obey the triangle inequality, so no row of a group is nearer to a query than
the angle between query and pivot allows. Each query first reads its nearest groups, until they hold enough
rows; its n-th distance there is a bound, and of the other groups only those are read that could hold a row
within the bound. Groups are folders, so the others are never opened. The result equals ``knn.knn``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.operators import knn
from corpusmill.operators.bm25 import rank_within
from corpusmill.session import ship_package

PIVOTS, RINGS, SAMPLE = 64, 8, 4096
#: Rows of the first groups of a query, at least.
HEAD = 4096
#: Slack for rounding: of angles, and of distances, which are rounded to six digits.
ANGLE_SLACK, DISTANCE_SLACK = 1e-6, 2e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ pivots.T, -1, 1))


def choose_pivots(sample: np.ndarray, k: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Unit vectors by k-means on directions, the same for the same set of rows."""
    x = _unit(sample[np.lexsort(sample.T)])
    pivots = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ pivots.T, axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), pivots)
    return pivots


def build_index(table: DataFrame, folder: str, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS) -> None:
    """Write ``rows`` (in folders of pivot and ring), ``schema``, ``groups`` and ``pivots`` below ``folder``.

    Vectors that are null, zero or not finite have no distance to anything and are left out. All others must have one length.
    """
    spark = table.sparkSession
    ship_package(spark)
    x = F.col(embedding).cast("array<double>")
    good = F.col(vec_id).isNotNull() & x.isNotNull() & F.exists(x, lambda c: c != 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(F.coalesce(good, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    knn.assert_uniform_dimension(rows)
    every = -(-rows.count() // SAMPLE) or 1
    sample = [r[0] for r in rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("embedding").limit(SAMPLE).collect()]
    sample = sample or [r[0] for r in rows.select("embedding").limit(1).collect()]
    chosen = choose_pivots(np.array(sample, float), pivots) if sample else np.empty((0, 1))
    schema = T.StructType([*rows.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("pivot", T.IntegerType()), T.StructField("ring", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(knn._matrix(batch.column(1)), chosen)
                pivot = angles.argmin(axis=1)
                angle = angles[np.arange(len(pivot)), pivot]
                ring = np.minimum((angle / (math.pi / 2) * RINGS).astype(np.int32), RINGS - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(pivot.astype(np.int32)), pa.array(ring)], schema.names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.mapInArrow(place, schema)
    # Angle in the range key: a group of very many rows is written by several tasks.
    placed.repartitionByRange(parts, "pivot", "ring", "angle", "vec_id").write.partitionBy("pivot", "ring").parquet(f"{folder}/rows")
    stored = spark.read.schema(schema).parquet(f"{folder}/rows")
    stored.limit(0).write.parquet(f"{folder}/schema")  # tells the columns of an index without rows
    stored.groupBy("pivot", "ring").agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("near"), F.max("angle").alias("far")
    ).coalesce(1).write.parquet(f"{folder}/groups")
    spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(chosen)], "pivot int, at array<double>").coalesce(1).write.parquet(f"{folder}/pivots")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/schema").schema).parquet(f"{folder}/rows")


class Plan:
    """Which groups each query of a batch has to read; ``groups`` is the directory."""

    def __init__(self, spark: SparkSession, folder: str, wanted: np.ndarray) -> None:
        self.groups = sorted(spark.read.parquet(f"{folder}/groups").collect(), key=lambda g: (g.pivot, g.ring))
        pivots = np.array([r["at"] for r in sorted(spark.read.parquet(f"{folder}/pivots").collect(), key=lambda r: r.pivot)])
        self.rows = np.array([g["rows"] for g in self.groups], np.int64)
        which = np.array([g.pivot for g in self.groups], np.int64)
        to = _angles(wanted, pivots)[:, which] if len(which) else np.empty((len(wanted), 0))
        near, far = (np.array([g[c] for g in self.groups]) for c in ("near", "far"))
        #: Least angle that a row of the group can have to the query.
        self.least = np.maximum(0, np.maximum(to - far, near - to) - ANGLE_SLACK)
        self.first = np.argsort(self.least + to * 1e-9, axis=1, kind="stable")

    def head(self, n: int) -> np.ndarray:
        """Groups of the nearest ``max(n, HEAD)`` rows of each query."""
        before = np.cumsum(self.rows[self.first], axis=1) - self.rows[self.first]
        out = np.zeros(self.least.shape, bool)
        np.put_along_axis(out, self.first, before < max(n, HEAD), axis=1)
        return out

    def within(self, distance: np.ndarray) -> np.ndarray:
        return 1 - np.cos(np.minimum(self.least, math.pi)) <= distance[:, None] + DISTANCE_SLACK


def _scan(spark: SparkSession, folder: str, plan: Plan, due: np.ndarray, query_ids: list, wanted: np.ndarray, n: int, out: T.StructType) -> DataFrame:
    """The best ``n`` of each task and query, from the groups that are ``due`` for the query."""
    stored = _rows(spark, folder)
    needed = np.flatnonzero(due.any(axis=0))
    if not len(needed):
        return spark.createDataFrame([], out)
    by_pivot: dict[int, list[int]] = {}
    for g in needed:
        by_pivot.setdefault(plan.groups[g].pivot, []).append(plan.groups[g].ring)
    of = F.lit(False)
    for pivot, rings in by_pivot.items():
        of = of | ((F.col("pivot") == pivot) & F.col("ring").isin(rings))
    asked = {(plan.groups[g].pivot, plan.groups[g].ring): np.flatnonzero(due[:, g]) for g in needed}
    shared = spark.sparkContext.broadcast((asked, wanted))
    arrow = to_arrow_schema(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = shared.value
        tops = {}
        for batch in batches:
            marks = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            ids, vectors = knn._ids(batch.column(0)), knn._matrix(batch.column(1))
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    for q in asked[marks[a]].tolist():
                        top = tops.setdefault(q, knn._TopN(1, n))
                        top.search(ids[a:b], vectors[a:b], wanted[q : q + 1])
        for q, top in tops.items():
            yield from top.table([query_ids[q]], arrow).to_batches()

    return stored.where(of).select("vec_id", "embedding", "pivot", "ring").mapInArrow(search, out)


def search(spark: SparkSession, folder: str, queries: DataFrame, n: int, max_floats: int = knn.MAX_BROADCAST_FLOATS) -> tuple[DataFrame, float]:
    """((query_id, vec_id, distance, rank), share of all (query, row) pairs that were compared).

    A batch of queries of more than ``max_floats`` numbers is an error: cut it first, or use ``knn.knn``.
    """
    ship_package(spark)
    wanted = queries.select("query_id", "embedding").where(F.size("embedding") > 0)
    out = knn._output(_rows(spark, folder), wanted)
    first = wanted.limit(1).collect()
    bound = max(1, max_floats // max(1, len(first[0].embedding) if first else 1))
    asked = [r for r in wanted.limit(bound + 1).collect() if any(r.embedding)]
    if len(asked) > bound:
        raise ValueError("too many queries for one batch")
    nothing = spark.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())]))
    if not asked or n <= 0:
        return nothing, 0.0
    ids, vectors = [r.query_id for r in asked], np.array([r.embedding for r in asked], float)
    plan = Plan(spark, folder, vectors)
    if not plan.groups:
        return nothing, 0.0
    head = plan.head(n)
    order = [F.asc("distance"), F.asc("vec_id")]
    seeds = rank_within(_scan(spark, folder, plan, head, ids, vectors, n, out), n, ["query_id"], order)
    kept = seeds.collect()  # n rows per query of the batch
    place = {q: i for i, q in enumerate(ids)}
    bounds = np.full(len(ids), np.inf)
    for r in kept:
        if r["rank"] == n:
            bounds[place[r.query_id]] = r.distance
    rest = plan.within(bounds) & ~head
    found = _scan(spark, folder, plan, rest, ids, vectors, n, out).unionByName(spark.createDataFrame([tuple(r)[:3] for r in kept], out))
    share = float(((head | rest) * plan.rows).sum() / (len(ids) * plan.rows.sum()))
    return rank_within(found, n, ["query_id"], order), share
