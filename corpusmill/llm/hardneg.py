"""Hard negatives by lists shared within clusters of anchors (MAXIMUS-style), exact integer inner products.

A cluster of anchors has a centre and a spread, the largest angle between the centre and a member. No member
can score more with a candidate than |member| * |candidate| * cos(max(0, angle(candidate, centre) - spread)).
Candidates are sorted by that bound once for the whole cluster. Each member walks the shared list
from its head, and stops as soon as the next bound, times its own length, is below the last score that it
still needs: from there on nothing can enter its result, which is thereby certified.

On Spark the list is dealt out by chunks:

* Candidates are one row per distinct (label, vector), with the smallest ids of its rows (as many as a result can hold). They lie in
  chunks of ``CHUNK`` rows at most, anchors in blocks of ``BLOCK``, both in order of (centroid, angle to it).
  Centroids are fitted on a bounded sample of anchors; they steer the order and never decide about a result.
* Head: each block walks the nearest chunks (of its own centroid and the ``NEIGHBOURS`` next to it) until they hold ``HEAD``
  candidates. The k-th best score found there is a floor of the final one.
* Rest: a chunk is visited by an anchor only if the bound for the chunk (angle between the centroids less both
  spreads, longest vector) reaches the anchor's floor. Chunks further down the list are never sent.
* A task holds one chunk and streams blocks of anchors past it. A chunk that very many anchors ask for is dealt
  out again, by slices of its anchors.

The same walk finds positives (same label, no window) and then negatives (other labels, a window of scores per
distinct positive score). Anchors with one label and vector walk once, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, table
from corpusmill.session import ship_package

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative scores from LOW to HIGH per cent of the positive.
LOW, HIGH = 30, 90
#: Rows of a chunk (as a power of two) and of a block; candidates per stride of a walk; anchors in a slice.
CHUNK_BITS, BLOCK_BITS, STRIDE, SLICE = 16, 8, 1024, 1 << 15
#: Candidates and centroids of the head of a list, which gives the first floors.
HEAD, NEIGHBOURS = 1 << 13, 4
#: Centroids, and the most vectors they are fitted on.
CENTROIDS, SAMPLE = 64, 4096
#: Slack of angles.
SLACK = 1e-6
NONE = -(2**63)


# ---- numpy: centroids and walks ------------------------------------------------------------------------------------


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-300)[:, None]


def fit_centroids(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 10) -> np.ndarray:
    """Unit vectors by spherical k-means, the same for the same set of rows."""
    x = _directions(sample[np.lexsort(sample.T)].astype(float)) if sample.size else sample.astype(float)
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        moved = np.einsum("ij,ij->i", sums, sums) > 1e-12
        centres = np.where(moved[:, None], _directions(sums), centres)
    return centres


class Block:
    """Anchors that walk together: one window of scores for each (anchor, target)."""

    def __init__(self, numbers, labels, vectors, targets, floors, same: bool, low: int, high: int) -> None:
        self.numbers, self.labels, self.x = numbers, labels, vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", *[vectors.astype(float)] * 2))
        mean = _directions(vectors.astype(float)).mean(axis=0)
        length = float(np.sqrt(mean @ mean))
        self.centre = mean / length if length > 1e-9 else None
        self.spread = np.pi if self.centre is None else float(_angles(vectors, self.norm, self.centre).max())
        self.member = np.repeat(np.arange(len(targets)), [len(t) for t in targets])
        self.target = np.array([p for t in targets for p in t], np.int64)
        if same:
            self.lo, self.hi = np.full(len(self.target), NONE), np.full(len(self.target), 2**63 - 1)
        else:
            self.lo = np.array([-(-low * int(p) // 100) for p in self.target], np.int64)
            self.hi = np.array([high * int(p) // 100 for p in self.target], np.int64)
        known = np.array([NONE if f is None else f for fs in floors for f in fs], np.int64)
        self.need = np.maximum(self.lo, known)


def _angles(x: np.ndarray, norm: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centre / np.maximum(norm, 1e-300), -1, 1))


def _scores(a: np.ndarray, x: np.ndarray, longest: float) -> np.ndarray:
    """Exact products: doubles hold them below 2^53 (no partial sum exceeds the product of the lengths)."""
    return (a.astype(float) @ x.astype(float).T).astype(np.int64) if longest < 2**53 else a @ x.T


def walk(
    block: Block, labels: np.ndarray, x: np.ndarray, norm: np.ndarray, first_id: np.ndarray, copies: np.ndarray, same: bool, k: int
) -> tuple[np.ndarray, ...]:
    """(window, score, candidate) of the candidates among which are the first ``k`` rows of each window, by score and id.

    A candidate stands for ``copies`` rows, of which ``first_id`` is the smallest id. ``labels`` are codes shared with
    ``block.labels``. ``block.need`` rises while walking.
    """
    if block.centre is None:
        bound = norm
    else:
        bound = norm * np.cos(np.maximum(0, _angles(x, norm, block.centre) - block.spread - SLACK))
    order = np.argsort(-bound, kind="stable")
    if same:
        order = order[np.isin(labels[order], block.labels)]
    bound, need = bound[order], block.need
    reach = block.norm * (1 + 1e-9)
    longest = float(block.norm.max(initial=0) * norm.max(initial=0))
    held = tuple(np.empty(0, np.int64) for _ in range(3))
    open_ = block.lo <= block.hi
    at = 0
    while at < len(order):
        # The bound only falls and needs only rise, so a window that is closed stays closed.
        top = bound[at] * (reach if bound[at] >= 0 else block.norm / (1 + 1e-9))
        open_ &= top[block.member] + 0.5 >= need
        windows = np.flatnonzero(open_)
        if not len(windows):
            break
        part = order[at : at + STRIDE]
        at += len(part)
        members, row = np.unique(block.member[windows], return_inverse=True)
        score = _scores(block.x[members], x[part], longest)
        fits = (block.labels[members][:, None] == labels[part]) == same
        score = score[row]
        ok = fits[row] & (score >= need[windows, None]) & (score <= block.hi[windows, None])
        w, j = np.nonzero(ok)
        if len(w):
            held = tuple(np.concatenate(p) for p in zip(held, (windows[w], score[w, j], part[j])))
            by = np.lexsort((first_id[held[2]], -held[1], held[0]))
            held = tuple(h[by] for h in held)
            window, value, rows = held[0], held[1], copies[held[2]]
            upto = np.cumsum(rows)
            fresh = np.append(True, window[1:] != window[:-1])
            level = fresh | np.append(True, value[1:] != value[:-1])
            of, step = np.cumsum(fresh) - 1, np.cumsum(level) - 1
            upto -= (upto - rows)[fresh][of]  # rows of the window up to here
            full = upto >= k
            np.maximum.at(need, window[full], value[full])
            # Before a candidate come all rows with a higher score, and of those with its own the first of each candidate.
            before = (upto - rows)[level][step] + np.arange(len(by)) - np.flatnonzero(level)[step]
            held = tuple(h[before < k] for h in held)
    return held


# ---- Spark: chunks, blocks, visits -----------------------------------------------------------------------------------


def _items(rows: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v (integers), anchor; distinct. Only rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    size = F.aggregate(x, F.lit(0.0), lambda s, c: s + (c * scale) * (c * scale))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~bad & (size < 2.0**60)
    return (
        rows.where(F.coalesce(good, F.lit(False)))
        .select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
            F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        )
        .groupBy("id", "label", "v").agg(F.max("anchor").alias("anchor"))
    )


def _placed(rows: DataFrame, centres: np.ndarray, bits: int) -> DataFrame:
    """Add width, cluster, angle, norm and ``lot`` (2^bits neighbouring rows of one cluster at most), and store.

    Vectors of another length than the centroids' are a cluster -1 of their length, to which no bound applies.
    """
    width = centres.shape[1]
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(names.index("v"))
            size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.cumsum(size) - size
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), flat * flat, len(size)))
            cluster, angle = np.full(len(size), -1, np.int32), np.full(len(size), np.pi)
            use = np.flatnonzero((size == width) & (norm > 0)) if len(centres) else np.empty(0, np.int64)
            if len(use):
                cosine = flat[starts[use][:, None] + np.arange(width)] @ centres.T / norm[use][:, None]
                cluster[use] = np.argmax(cosine, axis=1)
                angle[use] = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
            cols = [pa.array(size.astype(np.int32)), pa.array(cluster), pa.array(angle), pa.array(norm)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, "width", "cluster", "angle", "norm"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    made = rows.mapInArrow(run, f"{types}, width int, cluster int, angle double, norm double")
    key = ("width", "cluster", "angle", "tie")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = made.withColumn("tie", F.xxhash64("label", "v")).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    lot = F.concat_ws("/", "width", "cluster", F.shiftright("nr", bits))
    return stored(made.withColumn("nr", F.monotonically_increasing_id()).withColumn("lot", lot).drop("tie"))


def _extent(placed: DataFrame, lot: str) -> DataFrame:
    return placed.groupBy(F.col("lot").alias(lot), "width", "cluster").agg(
        F.min("angle").alias(f"{lot}_near"), F.max("angle").alias(f"{lot}_far"),
        F.min("norm").alias(f"{lot}_short"), F.max("norm").alias(f"{lot}_long"), F.count("*").alias(f"{lot}_rows"),
    )


def _reaches(angle: Column, spread: Column, norm: Column, need: Column) -> Column:
    """Whether a vector (or block) within ``spread`` of its centroid can score ``need`` in the chunk of the row."""
    cosine = F.cos(F.greatest(F.lit(0.0), angle - spread - F.col("chunk_far") - SLACK))
    bound = cosine * F.when(cosine >= 0, F.col("chunk_long")).otherwise(F.col("chunk_short"))
    return bound * norm + F.col("chunk_long") * norm * 1e-9 + 0.5 >= need


def _visits(asked: DataFrame, places: DataFrame, same: bool, k: int, low: int, high: int) -> DataFrame:
    """Walk each anchor of ``asked`` (nr, block, chunk, label, v, targets, floors) through its chunk:
    nr, target, score, own (an equal vector), ids of each candidate found."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = asked.groupBy("chunk").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    none = F.lit(None)
    asked = asked.join(slices, "chunk").select(
        "chunk", F.pmod(F.xxhash64("block"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), "block", "nr",
        "label", "v", none.cast("array<long>").alias("ids"), "targets", "floors",
    )
    candidates = places.withColumnRenamed("lot", "chunk").join(slices, "chunk").select(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), none.cast("string").alias("block"),
        "nr", "label", "v", "ids", none.cast("array<long>").alias("targets"), none.cast("array<long>").alias("floors"),
    )
    stream = candidates.unionByName(asked).repartition(parts, "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind", "block", "nr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: dict = {"key": None}
        for key, kind, block, rows in _runs(batches):
            if key != chunk["key"]:
                chunk = {"key": key, "rows": [], "x": None}
            if kind == 0:
                chunk["rows"].append(rows)
                continue
            if chunk["x"] is None:
                whole = pa.concat_tables([pa.Table.from_batches([r]) for r in chunk.pop("rows")]).combine_chunks()
                names, codes = np.unique(np.asarray(whole["label"].to_pylist(), object), return_inverse=True)
                x = _matrix(whole["v"])
                ids = whole["ids"].combine_chunks() if whole["ids"].num_chunks != 1 else whole["ids"].chunk(0)
                first = ids.flatten().to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]]
                norm = np.sqrt(np.einsum("ij,ij->i", *[x.astype(float)] * 2))
                chunk |= {"code": {n: i for i, n in enumerate(names)}, "labels": codes, "x": x, "norm": norm, "ids": ids, "first": first}
                chunk["copies"] = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            members = Block(
                rows.column(4).to_numpy(zero_copy_only=False), np.array([chunk["code"].get(n, -1) for n in rows.column(5).to_pylist()]),
                _matrix(rows.column(6)), rows.column(8).to_pylist(), rows.column(9).to_pylist(), same, low, high,
            )
            window, score, found = walk(members, chunk["labels"], chunk["x"], chunk["norm"], chunk["first"], chunk["copies"], same, k)
            own = (score == np.einsum("ij,ij->i", *[members.x] * 2)[members.member[window]]) & same
            own &= np.einsum("ij,ij->i", *[chunk["x"][found]] * 2) == score
            cols = [
                pa.array(members.numbers[members.member[window]], pa.int64()), pa.array(members.target[window]),
                pa.array(score), pa.array(own), chunk["ids"].take(pa.array(found)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["nr", "target", "score", "own", "ids"])

    return stream.mapInArrow(run, "nr long, target long, score long, own boolean, ids array<long>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, str | None, pa.RecordBatch]]:
    """(key, kind, block, rows) of consecutive rows: candidates in pieces, each block of anchors as a whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        chunk, slice_, kind, block = (batch.column(i).to_pylist() for i in range(4))
        marks = list(zip(chunk, slice_, kind, block))
        cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and marks[a] != last:
                yield (last[0], last[1]), last[2], last[3], _one(held)
                held = []
            last = marks[a]
            if last[2] == 0:
                yield (last[0], last[1]), 0, None, batch.slice(a, b - a)
            else:
                held.append(batch.slice(a, b - a))
    if held:
        yield (last[0], last[1]), last[2], last[3], _one(held)


def _one(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]


def _best(found: DataFrame, k: int) -> DataFrame:
    """nr, target, score, own, id, rank of the first ``k`` rows of each (nr, target)."""
    order = Window.partitionBy("nr", "target").orderBy(F.desc("score"), "id")
    rows = found.select("nr", "target", "score", "own", F.explode("ids").alias("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(anchors: DataFrame, places: DataFrame, angles: DataFrame, same: bool, k: int, low: int, high: int) -> DataFrame:
    """The first ``k`` rows for each target of each row of ``anchors`` (as placed, with ``targets``), over all of ``places``."""
    chunks, blocks = stored(_extent(places, "chunk")), _extent(anchors, "block")
    named = anchors.withColumnRenamed("lot", "block")
    gap = F.greatest(F.lit(0.0), F.col("chunk_near") - F.col("block_far"), F.col("block_near") - F.col("chunk_far"))
    nearest = Window.partitionBy("block").orderBy("apart", gap, "chunk").rowsBetween(Window.unboundedPreceding, -1)
    met = blocks.join(angles.where(F.col("place") <= NEIGHBOURS), "cluster").join(chunks.withColumnRenamed("cluster", "other"), ["width", "other"])
    head = met.withColumn("before", F.coalesce(F.sum("chunk_rows").over(nearest), F.lit(0))).where(F.col("before") < HEAD)
    head = stored(head.select("block", "chunk"))
    unknown = named.withColumn("floors", F.transform("targets", lambda t: F.lit(None).cast("long")))
    first = stored(_visits(unknown.join(head, "block"), places, same, k, low, high))

    # A floor is a k-th best score; without one, the window's own lower end (or none at all).
    kth = _best(first, k).where(F.col("rank") == k).groupBy("nr").agg(
        F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("kth")
    )
    floors = F.transform("targets", lambda t: F.try_element_at("kth", t))
    least = lambda t: F.lit(float("-inf")) if same else t.cast("double") * low / 100
    need = F.array_min(F.transform("targets", lambda t: F.coalesce(F.try_element_at("kth", t).cast("double"), least(t))))
    known = stored(named.join(kth, "nr", "left").withColumn("floors", floors).withColumn("need", need).drop("kth"))
    wanted = known.groupBy("block").agg(F.min(F.col("need") / F.greatest("norm", F.lit(1e-300))).alias("ratio"))
    pairs = (
        blocks.join(wanted, "block").join(angles, "cluster")
        .join(chunks.withColumnRenamed("cluster", "other"), ["width", "other"])
        .join(head.withColumn("seen", F.lit(True)), ["block", "chunk"], "left")
        .where(F.col("seen").isNull())
        # Per unit of length; half a point of slack goes to the shortest member.
        .where(_reaches(F.col("apart"), F.col("block_far"), F.lit(1.0), F.col("ratio") - 0.5 / F.greatest("block_short", F.lit(1e-300))))
        .select("block", "chunk", "apart", "chunk_far", "chunk_long", "chunk_short")
    )
    rest = known.join(pairs, "block").where(_reaches(F.col("apart"), F.col("angle"), F.col("norm"), F.col("need")))
    more = _visits(rest.select("nr", "block", "chunk", "label", "v", "targets", "floors"), places, same, k, low, high)
    return stored(_best(first.unionByName(more), k))


# ---- the operator ------------------------------------------------------------------------------------------------------


def _centres(anchors: DataFrame) -> np.ndarray:
    """Centroids of a sample of at most ``SAMPLE`` anchors of the most frequent length, chosen by a hash."""
    sizes = anchors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not sizes or not sizes[0].w:
        return np.empty((0, 1))
    every = -(-sizes[0]["count"] // SAMPLE)
    sample = anchors.where((F.size("v") == sizes[0].w) & (F.pmod(F.xxhash64("label", "v"), F.lit(every)) == 0)).select("v").limit(SAMPLE)
    return fit_centroids(np.array([r.v for r in sample.collect()], float).reshape(-1, sizes[0].w))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product of vectors whose components x became floor(scale * x). An anchor's positives are the first
    ``positives`` other rows of its label by (score descending, id); the negatives of each are the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null id, label or vector or any null or non-finite component take no part, nor do those so long
    (2^30 after scaling) that a score might not fit 64 bits. Vectors of different lengths are never compared. Rows
    that repeat id, label and vector count once; rows that share only the id are rows of their own. Anchors without
    positives, and positives without negatives, give no row; an empty table gives an empty result. Other columns are not looked at.
    """
    ship_package(rows.sparkSession)
    spark = rows.sparkSession
    items = stored(_items(rows, is_anchor, id_col, vector_col, label_col, scale))
    nth = Window.partitionBy("label", "v").orderBy("id")
    few = items.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= max(positives + 1, negatives))
    classes = few.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members = items.where("anchor").select("id", "label", "v")
    distinct = stored(members.select("label", "v").distinct())
    centres = _centres(distinct)
    places, anchors = _placed(classes, centres, CHUNK_BITS), _placed(distinct, centres, BLOCK_BITS)
    # Angles between centroids; nothing is known about a cluster without one. At most (CENTROIDS + 1)^2 rows.
    between = np.zeros((len(centres) + 1, len(centres) + 1))
    between[1:, 1:] = np.arccos(np.clip(centres @ centres.T, -1, 1))
    place = np.argsort(np.argsort(between, axis=1, kind="stable"), axis=1)
    angles = F.broadcast(spark.createDataFrame(
        [(i - 1, j - 1, float(between[i, j]), int(place[i, j])) for i, j in np.ndindex(between.shape)],
        "cluster int, other int, apart double, place int",
    ))

    one = anchors.withColumn("targets", F.array(F.lit(0).cast("long")))
    near = _search(one, places, angles, True, positives + 1, low, high)
    lists = near.groupBy("nr").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id", "own"))).alias("near"))
    chosen = (
        members.join(anchors.select("nr", "label", "v"), ["label", "v"]).select("nr", F.col("id").alias("anchor_id")).join(lists, "nr")
        .select("nr", "anchor_id", F.explode(F.slice(
            F.filter("near", lambda p: ~(p["own"] & (p["id"] == F.col("anchor_id")))), 1, positives
        )).alias("p"))
        .select("nr", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    )
    # A negative positive score leaves no window.
    targets = near.where("score >= 0").groupBy("nr").agg(F.array_sort(F.collect_set("score")).alias("targets"))
    far = _search(anchors.join(targets, "nr"), places, angles, False, negatives, low, high)
    return chosen.join(far.withColumnRenamed("target", "positive_score"), ["nr", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = f"""
WITH items AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM items a JOIN items b ON a.id <> b.id AND len(a.v) = len(b.v)
  WHERE a.id % 100 = 0
),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scores USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= {NEGATIVES}
"""
