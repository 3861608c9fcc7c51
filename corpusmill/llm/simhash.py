"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``DISTANCE`` differing bits are linked. The 64 bits are cut into six blocks; four
differing bits leave two blocks untouched, so a linked pair agrees on one of the fifteen pairs of
blocks. These masked bit patterns are the top of the index and the key of the shuffle. Below such a
pattern the distinct fingerprints are sorted by Gray rank and cut into leaves; a node keeps the bits
shared by all below it as (mask, pattern), upper nodes are made from runs of lower ones. Two nodes
whose patterns differ in more than ``DISTANCE`` bits of their common mask cannot hold a linked pair,
and the whole pair of groups is skipped; what is left at the leaves is compared bit by bit.

Only connections are kept, never pairs: each pattern reports a star per connected piece. A pattern
with more than ``GROUP`` distinct fingerprints is cut into blocks and joined block by block, in
several tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Forest, connected_components, stored, table
from corpusmill.session import ship_package

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Bit blocks: one more pair of untouched blocks than any four differing bits can spoil.
CUTS = (0, 11, 22, 33, 43, 54, 64)
LEAF = 32
FANOUT = 8
#: Distinct fingerprints of one pattern that a task compares; larger ones are cut into blocks.
GROUP = 16384
#: Node or fingerprint pairs looked at in one numpy step.
STEP = 1 << 20


# ---- fingerprints ----------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE, slice_words: int = 65536) -> int:
    """SimHash of the word shingles of a whole text; long texts are hashed in slices of bounded memory."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and the six white-space bytes alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, slice_words):
        part = words[at : at + slice_words + shingle - 1]
        flat = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        if len(part) < shingle:
            starts, stops = starts[:1], ends[-1:]
        else:
            starts, stops = starts[: len(part) - shingle + 1], ends[shingle - 1 :]
        hashes = np.array(
            [xxhash.xxh64_intdigest(flat[i:j], SEED) for i, j in zip(starts.tolist(), stops.tolist())], np.uint64
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (long) and ``fp`` (long, the unsigned fingerprint's bits) of every row; read where the text lies."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# ---- the index below one masked pattern ------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of every level, leaves first; fp is in Gray order."""

    def grouped(ones: np.ndarray, zeros: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(ones), width)
        return np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)

    ones, zeros = grouped(fp, ~fp, LEAF)
    levels = [(ones | zeros, ones)]
    while len(ones) > 1:
        ones, zeros = grouped(ones, zeros, FANOUT)
        levels.append((ones | zeros, ones))
    return levels


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def link_similar(fp: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Label (smallest index of its connected piece) of each fingerprint of one group."""
    order = np.argsort(gray_rank(fp), kind="stable")
    fp = fp[order]
    forest, n = Forest(len(fp)), len(fp)
    levels = _levels(fp)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > STEP // (FANOUT * FANOUT):
            half = len(a) // 2
            todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        width, count = (FANOUT, len(levels[level - 1][0])) if level else (LEAF, n)
        if level == 0 and len(a) > STEP // (LEAF * LEAF):
            for at in range(0, len(a), STEP // (LEAF * LEAF)):
                todo.append((0, a[at : at + STEP // (LEAF * LEAF)], b[at : at + STEP // (LEAF * LEAF)]))
            continue
        if level == 0:  # whole leaves that are one piece already have nothing to add
            first, last = forest.label[np.minimum(a * LEAF, n - 1)], None
            low = np.minimum.reduceat(forest.label, np.arange(0, n, LEAF))
            high = np.maximum.reduceat(forest.label, np.arange(0, n, LEAF))
            dull = (low[a] == high[a]) & (low[b] == high[b]) & (first == low[b])
            a, b = a[~dull], b[~dull]
            if not len(a):
                continue
        x = (a[:, None] * width + np.repeat(np.arange(width), width)).ravel()
        y = (b[:, None] * width + np.tile(np.arange(width), width)).ravel()
        fit = (x < count) & (y < count) & ((x < y) if level == 0 else (x <= y))
        x, y = x[fit], y[fit]
        if level:
            mask, pattern = levels[level - 1]
            near = _bits((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= distance
            todo.append((level - 1, x[near], y[near]))
        else:
            near = _bits(fp[x] ^ fp[y]) <= distance
            forest.link(x[near], y[near])
    label = np.empty(n, np.int64)
    label[order] = order[forest.label]
    # The smallest index in original order stands for the piece.
    low = np.full(n, n)
    np.minimum.at(low, label, np.arange(n))
    return low[label]


# ---- the distributed join --------------------------------------------------------------------------------------


def _masks() -> list[int]:
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(CUTS)]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, partitions: int) -> DataFrame:
    """Edges (a, b) between the representatives of ``fps`` (distinct ``fp``, long ``rep``) that connect all linked pairs."""
    routed = fps.select(
        "fp", "rep",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
            for i, m in enumerate(_masks())
        ])).alias("p"),
    ).select(F.col("p.c").alias("c"), F.col("p.key").alias("key"), "fp", "rep")
    large = routed.groupBy("c", "key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select(
        "c", "key", F.ceil(F.col("n") * 2 / GROUP).cast("int").alias("k")
    )
    # Block i of k meets every block j: the pair (i, j) is one task, so each row goes to k of them.
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    cut = routed.join(large, ["c", "key"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    placed = cut.withColumn("i", mine).select(
        "c", "key", "fp", "rep", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")
    ).select("c", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp", "rep")
    grouped = placed.repartition(partitions, "c", "key", "lo", "hi").sortWithinPartitions("c", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held.append((np.stack(cols[:4]), np.stack(cols[4:])))
                if not batch.num_rows:
                    continue
            if not held:
                continue
            keys, data = (np.concatenate([h[i] for h in held], axis=1) for i in (0, 1))
            if not keys.shape[1]:
                continue
            new = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            bounds = np.concatenate(([0], new, [keys.shape[1]]))
            if batch is not None:  # the last group may go on in the next batch
                held, bounds = [(keys[:, bounds[-2] :], data[:, bounds[-2] :])], bounds[:-1]
            out_a, out_b = [], []
            size = np.diff(bounds)
            # Pairs first, all at once; larger groups through their index.
            two = bounds[:-1][size == 2]
            x, y = data[0].view(np.uint64)[two], data[0].view(np.uint64)[two + 1]
            near = _bits(x ^ y) <= DISTANCE
            out_a.append(data[1][two[near]])
            out_b.append(data[1][two[near] + 1])
            for at in np.flatnonzero(size > 2).tolist():
                s, e = bounds[at], bounds[at + 1]
                label = link_similar(data[0, s:e].view(np.uint64))
                joined = np.flatnonzero(label != np.arange(e - s))
                out_a.append(data[1, s:e][joined])
                out_b.append(data[1, s:e][label[joined]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and wordless texts have fingerprint zero and are linked like others. Rows repeating an
    id and rows with equal texts share a fingerprint and so a component. Rows with a null id get a
    fingerprint; their component is that of the rows with an id which share it, or null. An empty
    table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    every = stored(fingerprints(docs, id_col, text_col))
    fps = stored(every.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    components = connected_components(links(fps, partitions))
    named = fps.join(components, fps.rep == components.node, "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return every.join(named, every.fp == F.col("_fp"), "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
