"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from banded MinHash: a pair at the threshold misses all ``BANDS`` buckets with a probability of
(1 - 0.8^ROWS)^BANDS = 3e-6, closer pairs with less. Every candidate that could connect two groups is verified on the whole
shingle sets, and only verified pairs form components. Pairs of fingerprints that op4's Gray-order index links are candidates
as well, and come first. (They cannot be the only ones: at 0.8 a pair of
fingerprints differs in about ten of 64 bits, and a bit index for twenty or more differing bits selects nothing.)

A bucket is not compared pair by pair at first: each member is verified against the smallest one. After that
only members of different components are compared, so a large group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import simhash
from corpusmill.llm.common import Forest, carried, connected_components, stored
from corpusmill.session import ship_package

SHINGLE = 5
BANDS, ROWS = 32, 5
#: Shingles of a task's documents of one bucket; larger buckets are cut into blocks and compared block by block.
GROUP = 1 << 19
_SLICE = 256  # shingles whose MinHash values are computed at once
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
# One odd factor for each place in a shingle.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a whole text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and the six white-space bytes alone
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    number: dict[bytes, int] = {}
    for w in words:
        if w not in number:
            number[w] = xxhash.xxh64_intdigest(w)
    codes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    h = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = _mixed(h ^ (codes[k : k + len(h)] * np.uint64(_ODD[k])))
    return np.unique(h)


def bands(found: np.ndarray) -> np.ndarray:
    """One bucket key per band; keys of different bands differ."""
    low, short = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _SLICE):
        x = short[at : at + _SLICE] * _A
        x += _B
        np.minimum(low, x.min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_ODD[0])
    for column in low.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ column) + column
    return _mixed(key).view(np.int64)


def similar(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Is the similarity of sets of a and b shingles with so many in common 4/5 or more? In whole numbers."""
    return 9 * both >= 4 * (a + b)


def link_members(component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Verified pairs (numbers of members) that connect all members of different components which are near copies."""
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    _, first, piece = np.unique(component, return_index=True, return_inverse=True)
    forest, out = Forest(len(sets)), []
    forest.link(np.arange(len(sets)), first[piece])
    largest = int(np.argmax(np.bincount(piece)))
    mark = np.zeros(int(code.max()) + 1, bool)
    for a in np.flatnonzero(piece != largest).tolist():
        fit = (forest.label != forest.label[a]) & similar(np.minimum(size, size[a]), size, size[a])
        if not fit.any():
            continue
        own = code[start[a] : start[a] + size[a]]
        mark[own] = True
        both = np.add.reduceat(mark[code], start, dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(fit & similar(both, size, size[a]))
        for b in near.tolist():
            if forest.label[a] != forest.label[b]:
                forest.link(np.array([a]), np.array([b]))
                out.append((a, b))
    return out


# ---- the distributed join --------------------------------------------------------------------------------------


def _marked(docs: DataFrame, id_col: str, text_col: str, want: str) -> DataFrame:
    """id, digest of the shingle set, its size n, and ``want``: keys (of the bands, with op4's fingerprint fp) or set (its bytes)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, more, prints = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                digest.append(xxhash.xxh64_intdigest(found.tobytes()))
                size.append(len(found))
                more.append(bands(found) if want == "keys" else found.tobytes())
                if want == "keys":
                    prints.append(simhash.fingerprint(text.as_py()))
            digests = pa.array(np.array(digest, np.uint64).view(np.int64))
            last = pa.array(more, pa.list_(pa.int64()) if want == "keys" else pa.binary())
            cols = [batch.column(0), digests, pa.array(size, pa.int64()), last]
            if want == "keys":
                cols.append(pa.array(np.array(prints, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "digest", "n", want, *(["fp"] if want == "keys" else [])]
    kinds = "keys array<long>, fp long" if want == "keys" else "set binary"
    return rows.where("id is not null").mapInArrow(run, f"id long, digest long, n long, {kinds}")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set of a, set of b) the pairs (a, b) that are near copies."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) from rows (key, lo, hi, digest, component, set) in order of their block of a bucket."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6))):
                yield tuple(v.as_py() for v in row)

    for _, block in itertools.groupby(rows(), key=lambda r: r[:3]):
        digest, component, sets = zip(*(r[3:] for r in block))
        pairs = link_members(np.array(component, np.int64), [np.frombuffer(s, np.uint64) for s in sets])
        if pairs:
            a, b = ([digest[p[i]] for p in pairs] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; all columns are carried along.

    A component holds the rows whose shingle sets are connected by pairs of near copies. A text of fewer than five words
    is one shingle; null and wordless texts have the same one. Rows with a null id stay and stand for nobody. Rows repeating an
    id are judged one by one: each goes only if its own text has a near copy under a smaller id. Empty in, empty out.
    """
    return carried(docs, _kept, {"doc_id": id_col, "text": text_col})


def _linked(once: DataFrame, partitions: int) -> DataFrame:
    """Pairs (a, b: digest, id, n) of ``once`` (with fp) that op4's index connects and whose sizes allow a near copy."""
    entry = F.struct("digest", "id", "n")
    prints = stored(once.groupBy("fp").agg(F.min(entry).alias("e")).select("fp", "e", F.col("e.digest").alias("rep")))
    edges = simhash.links(prints.select("fp", "rep"), partitions).distinct()
    ends = [prints.select(F.col("rep").alias(side), F.col("e").alias(f"e{side}")) for side in "ab"]
    apart = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("ea").alias("a"), F.col("eb").alias("b"))
    equal = once.join(prints.select("fp", F.col("e").alias("b")), "fp").select(entry.alias("a"), "b")
    return equal.unionByName(apart).where("a.digest <> b.digest and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)")


def _kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = stored(_marked(docs, id_col, text_col, "keys"))
    once = every.groupBy("digest").agg(F.min(F.struct("id", "n")).alias("e"), F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    entries = once.select("digest", "e.id", "e.n", F.explode("keys").alias("key"))
    centres = entries.groupBy("key").agg(F.min(F.struct("digest", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    members = stored(
        entries.join(centres.select("key", "c"), "key")
        .select("key", "id", "digest", "n", F.col("c.digest").alias("centre"), F.col("c.n").alias("centre_n"))
    )

    linked = stored(_linked(once.select("digest", "e.id", "e.n", "fp"), partitions))

    # The whole sets of all members, from one row of each.
    ends = [linked.select(F.col(f"{side}.digest").alias("digest"), F.col(f"{side}.id").alias("id")) for side in "ab"]
    wanted = members.select("digest", "id").unionByName(ends[0]).unionByName(ends[1]).distinct()
    texts = docs.join(wanted.select(F.col("id").alias("_id")).distinct(), F.col(id_col).cast("long") == F.col("_id"), "left_semi")
    sets = _marked(texts, id_col, text_col, "set").join(wanted, ["id", "digest"], "left_semi")
    sets = stored(sets.groupBy("digest").agg(F.max("set").alias("set")))

    # What the index links, and each member with the smallest of its bucket.
    star = members.where("digest <> centre and 5 * least(n, centre_n) >= 4 * greatest(n, centre_n)")
    star = linked.selectExpr("a.digest AS a", "b.digest AS b").union(star.select(F.col("digest").alias("a"), F.col("centre").alias("b")))
    star = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = star.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("x")), "a")
    star = star.join(sets.select(F.col("digest").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    links = stored(star.mapInArrow(_verified, "a long, b long"))
    components = connected_components(links)

    # Others of a bucket with each other, where they are not of one component yet.
    others = members.where("digest <> centre").join(components, F.col("digest") == F.col("node"), "left").select(
        "key", "digest", "n", F.coalesce("component", "digest").alias("component")
    )
    others = stored(others)
    open_ = others.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("n"))
    open_ = open_.where("low <> high").select("key", F.ceil(F.col("n") * 2 / GROUP).cast("int").alias("k"))
    cut = others.join(open_, "key").withColumn("i", F.pmod(F.xxhash64("digest"), F.col("k")).cast("int"))
    placed = cut.join(sets, "digest").select(
        "key", "digest", "component", "set", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")
    ).select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "digest", "component", "set")
    grouped = placed.repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = stored(grouped.mapInArrow(_joined, "a long, b long"))
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))

    rows = every.join(components, F.col("digest") == F.col("node"), "left").select(
        "id", "digest", F.coalesce("component", "digest").alias("component")
    )
    first = rows.groupBy("component").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    judged = stored(rows.join(first, "component", "left").select("id", "digest", F.expr("id > low").alias("goes")))
    gone = judged.where("goes").select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    # Ids with rows that go and rows that stay: their texts are looked at once more.
    mixed = judged.groupBy("id").agg(F.max(F.coalesce("goes", F.lit(False))).alias("any"), F.min(F.coalesce("goes", F.lit(False))).alias("all"))
    mixed = mixed.where("any and not all").select(F.col("id").alias("_id"))
    number = F.col(id_col).cast("long")
    clear = docs.join(gone.select("_id").distinct(), number == F.col("_id"), "left_anti")
    return clear.unionByName(_unlike(docs.join(mixed, number == F.col("_id"), "left_semi"), gone, id_col, text_col))


def _unlike(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and shingle set are not in ``gone``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = [xxhash.xxh64_intdigest(shingles(t.as_py()).tobytes()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array(digest, np.uint64).view(np.int64))], [*batch.schema.names, "_own"]
            )

    own = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_own", T.LongType())]))
    return own.join(
        gone, (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_own") == F.col("_digest")), "left_anti"
    ).drop("_own")
