"""Embedding near-duplicates by an epsilon grid order join.

Vectors of unit length are rotated onto the principal axes of the table and cut into cells of side
epsilon on the leading axes; epsilon is the distance of two unit vectors at the cosine threshold. In
the order of (label, cell, ...) the vectors form one sequence, which is cut into blocks of bounded
size. Two blocks can hold a linked pair only if the boxes around them on the leading axes are no more than
epsilon apart. Blocks meet on the cells of several leading axes which their boxes cover, each pair in one cell only, so
most pairs of blocks are never formed. Within a pair of blocks the sequence intervals are
halved recursively, and intervals whose boxes are too far apart are skipped; what is left is compared by
full dot products in double precision. Rotation only serves to skip, it never decides about a link.

Equal vectors of one label are one row with a weight, so a vector that is repeated in a third of
all rows costs nothing in the join. Each pair of blocks is a task's work of bounded size; a label
that holds everything is cut into blocks like any other.

Vectors of different lengths cannot be compared, so the length is part of the label. The axes are those of
the most frequent length; vectors of other lengths use their leading components, which skip less but as safely.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Forest, connected_components, stored, table
from corpusmill.session import ship_package

THRESHOLD = 0.93
#: Leading axes with cells for the order, with boxes, and with cells on which blocks meet.
CELLS, BOXES, MEET = 4, 12, 3
#: Vectors of a block, and of an interval that is compared without further halving.
BLOCK, LEAF = 1024, 128
#: Slack for rounding in distances used to skip.
SLACK = 1e-6


def _clean(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id``, ``label``, ``v`` (double array), and ``good``: whether the row can link at all."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~bad & some
    return rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"),
        F.coalesce(good, F.lit(False)).alias("good"),
    )


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """(width, width) rotation onto the axes of most variance; each task sends the sums of its rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), width))
            n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
        if n:
            sums = np.concatenate(([n], total, outer.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["i", "x"])

    sums = classes.select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    if not sums:
        return np.eye(width)
    flat = np.array([r.x for r in sums])
    mean = flat[1 : 1 + width] / flat[0]
    covariance = flat[1 + width :].reshape(width, width) / flat[0] - np.outer(mean, mean)
    return np.linalg.eigh((covariance + covariance.T) / 2)[1][:, ::-1]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) of the rows of each length."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
    found = ((w, np.flatnonzero(size == w)) for w in np.unique(size))
    return [(at, _unit(flat[starts[at][:, None] + np.arange(w)])) for w, at in found]


def _on_axes(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the leading axes; a vector of another length than theirs gives its leading components."""
    if x.shape[1] == len(axes):
        return x @ axes
    out = np.zeros((len(x), axes.shape[1]))
    n = min(out.shape[1], x.shape[1])
    out[:, :n] = x[:, :n]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) > (eps + SLACK) ** 2


def join_intervals(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a and b) with cosine of at least ``threshold``; ``same``: a is b, each pair once."""
    eps = float(np.sqrt(2 - 2 * threshold))
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k < i:
            continue
        if _apart(pa_[i:j].min(0), pa_[i:j].max(0), pb[k:m].min(0), pb[k:m].max(0), eps):
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a[i:j] @ b[k:m].T >= threshold)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y
            continue
        h, g = (i + j) // 2, (k + m) // 2
        if same and (i, j) == (k, m):
            todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif j - i >= m - k:
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            todo += [(i, j, k, g), (i, j, g, m)]


def _blocks(classes: DataFrame, axes: Broadcast, eps: float) -> DataFrame:
    """Blocks of the sequence: block, label, lo, hi (boxes), reps, weights, vectors (bytes)."""
    spark, cells = classes.sparkSession, min(CELLS, axes.value.shape[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros((batch.num_rows, cells), np.int32)
            for rows, x in _rows(batch.column(3)):
                at[rows] = np.floor(_on_axes(x, axes.value)[:, :cells] / eps)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * cells), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "cell"])

    ordered = classes.select("label", "rep", "weight", "v").mapInArrow(
        place, "label string, rep long, weight long, v array<double>, cell array<int>"
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(partitions, "label", "cell", "rep").sortWithinPartitions("label", "cell", "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "label", "lo", "hi", "reps", "weights", "vectors"]
        types = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 3]

        def block(label: str, reps: np.ndarray, weights: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            p = _on_axes(x, axes.value)
            row = (
                uuid.uuid4().hex, label, p.min(0), p.max(0),
                reps.tobytes(), weights.tobytes(), x.tobytes(),
            )
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names)

        label, held = None, []
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            reps, weights = (batch.column(i).to_numpy() for i in (1, 2))
            vectors = batch.column(3)
            ends = [*(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
            at = 0
            for end in ends:
                if at == end:
                    continue
                if held and (labels[at] != label):
                    yield block(label, *map(np.concatenate, zip(*held)))
                    held = []
                label = labels[at]
                x, first = _rows(vectors.slice(at, end - at))[0][1], at  # one length, as it is part of the label
                while at < end:
                    room = BLOCK - sum(len(h[0]) for h in held)
                    to = min(end, at + room)
                    held.append((reps[at:to], weights[at:to], x[at - first : to - first]))
                    if to - at == room:
                        yield block(label, *map(np.concatenate, zip(*held)))
                        held = []
                    at = to
        if held:
            yield block(label, *map(np.concatenate, zip(*held)))

    return ordered.mapInArrow(
        cut,
        "block string, label string, lo array<double>, hi array<double>, reps binary, weights binary, vectors binary",
    )


def _pairs(blocks: DataFrame, eps: float, axes: int) -> DataFrame:
    """Pairs of blocks of one label (each once, and each block with itself) whose boxes are within epsilon.

    A box covers cells of the leading ``axes``; that of the second block is one cell wider on either side. A pair
    is formed only in the first cell that both cover, so it needs no removal of repetitions, and blocks that are
    apart on any of these axes do not meet.
    """
    box = blocks.select("block", "label", "lo", "hi")

    def covered(suffix: str, wider: int) -> DataFrame:
        out = box.select(*(F.col(c).alias(f"{c}{suffix}") for c in box.columns))
        for i in range(axes):
            low, high = (F.floor(F.get(f"{c}{suffix}", F.lit(i)) / eps).cast("long") for c in ("lo", "hi"))
            out = out.withColumn(f"from{suffix}{i}", low - wider).withColumn(f"c{i}", F.explode(F.sequence(low - wider, high + wider)))
        return out

    left, right = covered("", 0), covered("2", 1)
    met = left.withColumnRenamed("label", "label2").join(right, ["label2", *(f"c{i}" for i in range(axes))])
    first = F.col("block") <= F.col("block2")
    for i in range(axes):
        first &= F.col(f"c{i}") == F.greatest(f"from{i}", f"from2{i}")
    gaps = F.zip_with(
        F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b),
        lambda a, b: F.greatest(F.lit(0.0), a, b),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return met.where(first & (apart <= (eps + SLACK) ** 2)).select("block", "block2")


def near_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links (other rows linked directly), component_id, kept.

    Only rows of one label that is not null and of one length are compared. A vector that is null, zero or holds a null or
    non-finite component links with nothing. Rows without an id link with nothing and have no component.
    Rows that repeat an id and vector link with each other like any copies; each counts and each is
    returned. Other columns are not looked at; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    every = _clean(rows, id_col, vector_col, label_col)
    widths = every.where("good").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = widths[0].w if widths else 1
    # -0.0 and 0.0 are one number here, so that equal vectors are one class.
    every = every.select(
        "id", F.concat_ws("/", F.size("v"), F.col("label").cast("string")).alias("label"),
        F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "good",
    )
    classes = stored(
        every.where("good").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    )
    eps = float(np.sqrt(2 - 2 * threshold))
    axes = spark.sparkContext.broadcast(np.ascontiguousarray(principal_axes(classes.where(F.size("v") == width), width)[:, : min(BOXES, width)]))
    blocks = stored(_blocks(classes, axes, eps))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = ("reps", "weights", "vectors")
    both = (
        _pairs(blocks, eps, min(MEET, axes.value.shape[1]))
        .join(blocks.select("block", *(F.col(p).alias(f"{p}1") for p in parts)), "block")
        .join(blocks.select(F.col("block").alias("block2"), *(F.col(p).alias(f"{p}2") for p in parts)), "block2")
        .repartition(partitions)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                same = at["block"][i].as_py() == at["block2"][i].as_py()
                reps, weights, vectors = (
                    [np.frombuffer(at[f"{p}{side}"][i].as_py(), kind) for side in (1, 2)]
                    for p, kind in zip(parts, (np.int64, np.int64, np.float64))
                )
                a, b = (v.reshape(len(r), -1) for r, v in zip(reps, vectors))
                offset = 0 if same else len(a)  # numbers of b's vectors among the items of both
                ids = reps[0] if same else np.concatenate(reps)
                count, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
                for x, y in join_intervals(a, b, _on_axes(a, axes.value), _on_axes(b, axes.value), same, threshold):
                    np.add.at(count, x, weights[1][y])
                    np.add.at(count, y + offset, weights[0][x])
                    forest.link(x, y + offset)
                use = np.flatnonzero(count > 0)
                out = [ids[use], ids[forest.label[use]], count[use]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["a", "b", "n"])

    # Each linked vector of each pair of blocks: its links there, and a link to the first of its piece.
    found = stored(both.mapInArrow(run, "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    components = connected_components(found.select("a", "b"))
    settled = (
        classes.join(links, classes.rep == links.a, "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("_label"), F.col("v").alias("_v"),
            (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("_component"),
        )
    )
    # Only rows that can link look for their class; the others stand for themselves.
    linked = every.where("good").join(
        settled, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))
    ).select("id", "n_links", F.col("_component").alias("component_id"))
    alone = every.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op5_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
