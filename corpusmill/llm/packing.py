"""Packing into fixed windows by non-negative least squares over the length histogram.

Tokens of a document are cut into full windows, a body whose length is a multiple of ``GRAIN``, and a tail
shorter than that. Only bodies and tails have to be combined. For both the same solver is used: it enumerates
the shallow combinations of lengths which fill a window exactly (bodies a window of 2048 tokens in grains,
tails a grain in tokens), solves how often each should repeat so that the histogram of lengths is matched
best (non-negative least squares), and rounds down within what is there. The residual is packed greedily:
bodies one after the other, cut where a window is full, and tails the longest that still fits first. All
planning works on histograms of ``WINDOW / GRAIN`` and ``GRAIN`` bins, whatever the data.

A piece then needs only its rank among the pieces of its length: ranks are per-task counts plus the
counts of the tasks before, and a rank falls into one repeat of one combination by arithmetic. No piece
is sorted or sent anywhere to be placed, and a length that a third of all documents have is not special.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, table
from corpusmill.session import ship_package

WINDOW = 2048
GRAIN = 32
END = 1
#: Parts of an enumerated combination.
DEPTH = 4


# ---- tokens ----------------------------------------------------------------------------------------------------


@cache
def _encoder(path: str):
    """The byte-level vocabulary of a tokenizers file, encoded by ranks; its added tokens are found in texts as there."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path) as f:
        spec = json.load(f)
    # GPT-style byte alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a whole text, and the end id, as little-endian 32-bit numbers."""
    try:
        ids = _encoder(path).encode(text, allowed_special="all")
    except ValueError:  # the splitting pattern gives up on millions of white-space characters in a row
        ids = _library(path).encode(text, add_special_tokens=False).ids
    return np.append(np.array(ids, "<u4"), np.array([END], "<u4"))


@cache
def _shifts() -> np.ndarray:
    """[k, bit]: what a CRC-32 that has only ``bit`` set becomes when k grains of other bytes follow, up to their own CRC."""
    grain = bytes(4 * GRAIN)
    plain = zlib.crc32(grain)
    one = np.array([zlib.crc32(grain, 1 << i) ^ plain for i in range(32)], np.uint32)
    out = [np.array([1 << i for i in range(32)], np.uint32)]
    bit = np.arange(32, dtype=np.uint32)
    for _ in range(WINDOW // GRAIN):
        set_ = (out[-1][:, None] >> bit & 1).astype(bool)
        out.append(np.bitwise_xor.reduce(np.where(set_, one, 0), axis=1).astype(np.uint32))
    return np.array(out)


def grain_sums(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of the first k grains and of all after them, for each k from 0 to the number of grains."""
    n, heads = len(body) // GRAIN, [0]
    for k in range(n):
        heads.append(zlib.crc32(body[k * GRAIN : (k + 1) * GRAIN].tobytes(), heads[-1]))
    heads = np.array(heads, np.uint32)
    # CRC(all) = shift(CRC(head)) ^ CRC(rest), and shifting is linear over bits.
    basis = _shifts()[n - np.arange(n + 1)]
    set_ = (heads[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(bool)
    return heads, heads[-1] ^ np.bitwise_xor.reduce(np.where(set_, basis, 0), axis=1).astype(np.uint32)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, kind (0 window, 1 body, 2 tail), nr, heads,
    rests, task.

    ``nr`` numbers the pieces of one length within a task. Tokens are made once and only check sums
    leave the task; a body brings those of each place where it may still be cut.
    """
    ship_package(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "nr", "heads", "rests"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = token_ids(text.as_py() or "", path)
                n = len(ids)
                full = n - n % WINDOW
                body = (n - full) - (n - full) % GRAIN
                cuts = [*((at, WINDOW, 0) for at in range(0, full, WINDOW)), (full, body, 1), (full + body, n - full - body, 2)]
                for start, length, kind in cuts:
                    if length:
                        part = ids[start : start + length]
                        nr = seen[kind, length] = seen.get((kind, length), -1) + 1
                        sums = [x.view(np.int32) for x in grain_sums(part)] if kind == 1 else [None, None]
                        rows.append((doc.as_py(), start, length, zlib.crc32(part.tobytes()), n, kind, nr, *sums))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, nr long, "
        "heads array<int>, rests array<int>",
    )
    return made.withColumn("task", F.spark_partition_id())


# ---- the plan over histograms ----------------------------------------------------------------------------------


def combinations(window: int, depth: int = DEPTH) -> np.ndarray:
    """All ways to fill a window of ``window`` units exactly with up to ``depth`` parts below it, as rows of part counts.

    Deeper ways are left out but for repeats of one length, so that small parts can fill a window alone.
    """
    found: set[tuple[int, ...]] = set()

    def extend(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.add(parts)
        elif len(parts) < depth:
            for p in range(min(left, parts[-1] if parts else window - 1), 0, -1):
                if p * (depth - len(parts)) >= left:
                    extend((*parts, p), left - p)

    extend((), window)
    for p in range(1, window):
        if window % p == 0:
            found.add((p,) * (window // p))
        elif window % p < p:
            found.add((*(p,) * (window // p), window % p))
    rows = np.zeros((len(found), window), np.int64)
    for i, parts in enumerate(sorted(found, reverse=True)):
        for p in parts:
            rows[i, p] += 1
    return rows


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x with the least ||a x - b||: the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, target = a.T @ a, a.T @ b
    for _ in range(steps):
        slope = target - gram @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(target).max())):
            break
        active[best] = True
        while True:
            where = np.flatnonzero(active)
            free = np.linalg.lstsq(a[:, where], b, rcond=None)[0]
            if (free > 1e-12).all():
                x[:] = 0
                x[where] = free
                break
            low = free <= 1e-12
            ratio = x[where][low] / np.maximum(x[where][low] - free[low], 1e-300)
            x[where] += ratio.min() * (free - x[where])
            active[where[x[where] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


Plan = list[tuple[tuple[int, ...], int]]  # (parts, repeats)


def solve(histogram: np.ndarray, window: int) -> tuple[Plan, np.ndarray]:
    """Repeats of combinations that fill the window exactly, within the counts by length (0 to window - 1); what is left."""
    left, out = histogram.astype(np.int64).copy(), []
    if left.any():
        ways = combinations(window)
        scale = float(left.max())
        # Long parts have few partners, so they weigh more: what stays over of them costs most.
        weight = np.arange(window, dtype=float)[:, None] / window
        solved = nnls(ways.T * weight, left / scale * weight[:, 0]) * scale
        for i in np.argsort(-solved, kind="stable"):
            has = ways[i] > 0
            times = min(int(solved[i]), int((left[has] // ways[i][has]).min())) if solved[i] > 0 else 0
            if times:
                left -= ways[i] * times
                out.append((tuple(int(p) for p in np.repeat(np.arange(window), ways[i])[::-1]), times))
    return out, left


def fill_greedily(left: np.ndarray, window: int) -> Plan:
    """Use up the counts by length: the longest part there is, then always the longest that still fits.

    A filling repeats as often as the counts allow, so the number of steps depends on the bins alone.
    """
    left, out = left.copy(), []
    while left.any():
        counts, room = np.zeros(len(left), np.int64), window
        for p in np.flatnonzero(left)[::-1].tolist():
            counts[p] = min(int(left[p]), room // p)
            room -= p * counts[p]
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        left -= counts * times
        out.append((tuple(int(p) for p in np.repeat(np.arange(len(left)), counts)[::-1]), times))
    return out


def _places(made: Plan, first: int, rank: dict[int, int]) -> tuple[list[tuple], int]:
    """(length, from rank, to rank, copies, first unit, first window) of each run of equal parts; the next window.

    ``rank`` holds the next free rank of each length and is moved on.
    """
    rows, window = [], first
    for parts, times in made:
        at = 0
        for p, same in itertools.groupby(parts):
            copies = len(list(same))
            start = rank.get(p, 0)
            rank[p] = start + copies * times
            rows.append((p, start, rank[p], copies, at, window))
            at += p * copies
        window += times
    return rows, window


def layout(counts: dict[tuple[int, int], int]) -> list[tuple[int, ...]]:
    """(kind, length, from rank, to rank, copies, first token, first window, window) for counts by (kind, length).

    Rank r of a length stands in window ``first window + (r - from) // copies``, copy ``(r - from) % copies``.
    ``window`` 0 marks residual bodies, which stand one after the other from token ``first token`` on
    and may be cut at the end of a sequence; GRAIN marks tails in grains, whose number counts from
    ``first window`` in units of a grain.
    """
    units = WINDOW // GRAIN
    windows = counts.get((0, WINDOW), 0)
    rows: list[tuple[int, ...]] = [(0, WINDOW, 0, windows, 1, 0, 0, WINDOW)]
    bodies, left = solve(np.array([counts.get((1, u * GRAIN), 0) for u in range(units)]), units)
    rank: dict[int, int] = {}
    placed, at = _places(bodies, windows, rank)
    rows += [(1, p * GRAIN, a, b, c, u * GRAIN, s, WINDOW) for p, a, b, c, u, s in placed]
    token = at * WINDOW
    for p in np.flatnonzero(left)[::-1].tolist():
        start = rank.get(p, 0)
        rows.append((1, p * GRAIN, start, start + int(left[p]), 1, token, 0, 0))
        token += int(left[p]) * p * GRAIN
    grain = token // GRAIN  # whole grains go on where the residual bodies end
    tails, left = solve(np.array([counts.get((2, t), 0) for t in range(GRAIN)]), GRAIN)
    rank = {}
    placed, grain = _places(tails, grain, rank)
    rows += [(2, p, a, b, c, u, g, GRAIN) for p, a, b, c, u, g in placed]
    placed, _ = _places(fill_greedily(left, WINDOW), -(-grain // units), rank)
    return rows + [(2, p, a, b, c, u, s, WINDOW) for p, a, b, c, u, s in placed]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only the last sequence of whole grains and those of residual tails have padding. A null or empty text is its end id alone. Rows that repeat an id are documents of
    their own, and so are rows with a null id. Other columns are not looked at; an empty table gives
    no piece.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, path, id_col, text_col))
    by_task = made.groupBy("kind", "length", "task").agg(F.count("*").alias("n"))
    # One row per length: 1 + WINDOW / GRAIN + GRAIN at most.
    totals = by_task.groupBy("kind", "length").agg(F.sum("n").alias("n")).collect()
    places = spark.createDataFrame(
        layout({(r.kind, r.length): r.n for r in totals}),
        "k int, l long, lo long, hi long, copies long, at long, first long, wide long",
    )

    # Rank of a piece: pieces of its length in earlier tasks, and its number in its own.
    earlier = Window.partitionBy("kind", "length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = made.join(offsets, ["kind", "length", "task"]).withColumn("rank", F.col("before") + F.col("nr"))
    # `places` has a few rows for each of the combinations, of which the solver uses as many as there are lengths.
    put = ranked.join(
        F.broadcast(places),
        (F.col("kind") == F.col("k")) & (F.col("length") == F.col("l"))
        & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    ).withColumn("r", F.col("rank") - F.col("lo"))
    token = (
        F.when(F.col("wide") == 0, F.col("at") + F.col("r") * F.col("length"))
        .otherwise(
            (F.col("first") + F.floor(F.col("r") / F.col("copies"))) * F.col("wide")
            + F.col("at") + F.col("r") % F.col("copies") * F.col("length")
        )
        .cast("long")
    )
    put = put.withColumn("token", token).withColumn("room", F.lit(WINDOW) - F.col("token") % WINDOW)

    def part(start, length, crc, at) -> Column:
        return F.struct(
            start.alias("start"), length.alias("length"), crc.alias("ids_crc32"),
            F.floor(at / WINDOW).cast("long").alias("sequence_id"), (at % WINDOW).alias("offset"),
        )

    def sum_at(column: str) -> Column:
        return F.get(column, (F.col("room") / GRAIN).cast("int")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))

    start, length, room, at = F.col("start"), F.col("length"), F.col("room"), F.col("token")
    halves = F.array(
        part(start, room, sum_at("heads"), at), part(start + room, length - room, sum_at("rests"), at + room)
    )
    whole = F.array(part(start, length, F.col("ids_crc32"), at))
    return put.select(
        "doc_id", "doc_tokens", F.explode(F.when(room < length, halves).otherwise(whole)).alias("p")
    ).select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
