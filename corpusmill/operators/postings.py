"""BM25 over a stored postings table, with score bounds.

Index. Documents are numbered in order of their scope and id and cut into blocks. The postings table has
one row per (scope, term, block), or several with different documents: positions in the block, the part of the score each document gets for
the term (before the term's weight), and the largest of these parts, the peak. Peaks alone, a column that parquet
reads without the arrays, bound what a query can score in a block: the sum of weight times peak.

Search, for a batch of queries:

1. bounds per (query, block), from peaks;
2. the few blocks with the highest bounds are scored; the k-th best score found is the query's threshold;
3. only blocks whose bound reaches the threshold are fetched. A block's postings travel once and meet all queries that
   ask for it; terms come by falling bound, and once the terms that are
   left cannot lift a new document to the threshold, they are added to documents already met only. Words that stand
   in most documents come last, so they make no row or score of their own.

Only the k best of each query and block leave a task. Results equal ``bm25.bm25_topk``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import fixed
from corpusmill.functions.text import tokenize
from corpusmill.operators.bm25 import idf, query_terms
from corpusmill.session import bounded_broadcast, ensure_checkpoint_dir, ship_package

#: Documents of a block, as a power of two.
BLOCK_BITS = 12
#: Files of the postings table by hash of the term, so that a small batch of queries opens few of them.
BUCKETS = 32
#: Blocks scored first.
HEAD = 4
#: Tokens of documents whose postings are made at once.
LOT = 4_000_000
#: Rounding of scores, and the slack under which a bound still counts as reaching a threshold.
DIGITS, SLACK = 6, 1e-5


_POSTING = (
    T.StructType().add("term", "string").add("block", "long").add("n", "integer").add("positions", T.ArrayType(T.IntegerType()))
    .add("impacts", T.ArrayType(T.DoubleType())).add("peak", "double").add("bucket", "integer")
)


def build_index(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", scope: list[str] | None = None,
    k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, bits: int = BLOCK_BITS,
) -> None:
    """Write ``documents`` and ``postings`` below ``folder``.

    ``scope`` columns split the corpus into collections with statistics of their own. A null text has no
    token and still counts as a document. Ids may repeat; each row is a document.
    """
    spark, scope = docs.sparkSession, scope or []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *scope, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # A random second key lets a hot id spread over partitions.
    ordered = rows.withColumn("_tie", F.xxhash64("_text")).repartitionByRange(parts, *scope, "doc_id", "_tie").sortWithinPartitions(*scope, "doc_id", "_tie")
    numbered = ordered.select(
        F.monotonically_increasing_id().alias("at"), "doc_id", *scope, tokenize(F.col("_text")).alias("tokens")
    ).select("*", F.size("tokens").alias("dl"))
    numbered.write.parquet(f"{folder}/documents")
    numbered = spark.read.parquet(f"{folder}/documents")
    means = _statistics(numbered, scope)
    ship_package(spark)
    # Documents lie in order of their blocks, so a block's postings are made where it is read; only they are shuffled.
    kinds = [f for f in numbered.schema.fields if f.name in scope]
    made = T.StructType([*kinds, *(f for f in _POSTING.fields if f.name != "bucket")])
    blocks = _with(numbered, means, scope).select("at", "dl", "avgdl", "tokens", *scope).mapInArrow(_inverter(made, len(scope), k1, b, bits), made)
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    share = F.pmod(F.col("block"), F.lit(max(1, 4 * parts // BUCKETS)))
    blocks.repartition(parts, "bucket", share).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")


def _inverter(made: T.StructType, n_scope: int, k1: float, b: float, bits: int):
    """Arrow step: documents (at, dl, avgdl, tokens, scope) in order to postings, block by block and ``LOT`` tokens at a time.

    A block that is cut by the end of a lot or of a task has several rows of a term, with different documents.
    """
    names = made.names

    def inverted(part: pa.RecordBatch) -> pa.RecordBatch:
        at, dl = part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.float64)
        norm = k1 * ((1.0 - b) + b * dl / part.column(2).to_numpy())
        sizes = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
        words = part.column(3).flatten().dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        key, tf = np.unique(code * len(at) + np.repeat(np.arange(len(at)), sizes), return_counts=True)
        term, doc = np.divmod(key, len(at))
        impact = tf * (k1 + 1.0) / (tf + norm[doc])
        first = np.flatnonzero(np.diff(term, prepend=-1))
        ends = pa.array(np.append(first, len(term)).astype(np.int32))
        n, every = np.diff(np.append(first, len(term))).astype(np.int32), len(first)
        scope = [part.column(4 + i).take(pa.array(np.zeros(every, np.int64))) for i in range(n_scope)]
        cols = [
            *scope, words.dictionary.take(pa.array(term[first])), pa.array(np.full(every, at[0] >> bits)), pa.array(n),
            pa.ListArray.from_arrays(ends, pa.array((at[doc] % (1 << bits)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(impact)),
            pa.array(np.maximum.reduceat(impact, first)),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, words = None, 0
        for batch in batches:
            marks = list(zip((batch.column(0).to_numpy() >> bits).tolist(), *(batch.column(4 + i).to_pylist() for i in range(n_scope))))
            total = np.cumsum(batch.column(1).to_numpy().astype(np.int64))
            cuts = [0]
            for i in range(1, len(marks)):
                if marks[i] != marks[i - 1] or total[i] - total[cuts[-1]] > LOT:
                    cuts.append(i)
            for start, end in zip(cuts, [*cuts[1:], len(marks)]):
                if start == end:
                    continue
                if held and (marks[start] != now or words > LOT):
                    yield from made_of(held)
                    held, words = [], 0
                now = marks[start]
                held.append(batch.slice(start, end - start))
                words += int(total[end - 1] - (total[start - 1] if start else 0))
        yield from made_of(held)

    def made_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if len(part.column(3).flatten()):
                yield inverted(part)

    return run


def _with(rows: DataFrame, means: DataFrame, scope: list[str]) -> DataFrame:
    """Add n_docs and avgdl; without a scope they are two numbers."""
    if scope:
        return rows.join(means, scope)
    return rows.select("*", *(means.select(c).scalar().alias(c) for c in ("n_docs", "avgdl")))


def _statistics(numbered: DataFrame, scope: list[str]) -> DataFrame:
    """n_docs and avgdl of each scope."""
    return numbered.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_docs"), (F.sum(F.col("dl").cast("long")) / F.count(F.lit(1))).alias("avgdl")
    )


def weighted_terms(spark: SparkSession, folder: str, queries: DataFrame, scope: list[str], **names: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, scope, term, weight), and the postings of the queries' terms."""
    terms = query_terms(queries, **names)
    vocabulary = bounded_broadcast(terms.select("term").distinct(), queries, 4)
    buckets = [r.b for r in vocabulary.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
    # Given, as an index without a posting has no file to tell it.
    fields = [f for f in spark.read.parquet(f"{folder}/documents").schema if f.name in scope]
    postings = spark.read.schema(T.StructType([*fields, *_POSTING.fields])).parquet(f"{folder}/postings")
    postings = postings.where(F.col("bucket").isin(buckets)).join(vocabulary, "term", "left_semi")
    counts = postings.groupBy(*scope, "term").agg(F.sum("n").alias("df"))
    known = _with(counts, _statistics(spark.read.parquet(f"{folder}/documents"), scope), scope)
    weights = terms.join(known, "term").select(
        "query_id", *scope, "term", (idf(F.col("n_docs"), F.col("df")) * F.col("qtf")).alias("weight")
    )
    return weights, postings


def block_bounds(weights: DataFrame, postings: DataFrame, queries: DataFrame, scope: list[str]) -> DataFrame:
    """(query_id, scope, block, bound, n): the most a document of the block can score; reads peaks only."""
    small = bounded_broadcast(weights, queries, 32 * (64 if scope else 1))
    return postings.select(*scope, "term", "block", "n", "peak").join(small, [*scope, "term"]).groupBy("query_id", *scope, "block").agg(
        F.sum(F.col("weight") * F.col("peak")).alias("bound"), F.sum("n").alias("n")
    )


def _scored(pairs: DataFrame, weights: DataFrame, postings: DataFrame, scope: list[str], k: int, bits: int) -> DataFrame:
    """The best ``k`` of each of ``pairs`` (query_id, scope, block, floor): query_id, scope, at, score.

    A block's postings travel once and meet all its queries in one task, whatever their number is.
    """
    spark = pairs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, place = ["query_id", *scope], [*scope, "block"]
    asked = weights.groupBy(*keys).agg(F.collect_list(F.struct("term", "weight")).alias("w"))
    asked = pairs.select(*keys, "block", "floor").join(asked, keys).select(*keys, "block", "floor", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"))
    found = postings.select(*place, "term", "peak", "positions", "impacts").join(asked.select(*place).distinct(), place, "left_semi")
    fields = {f.name: f.dataType for f in asked.schema.fields}
    out = T.StructType([*(T.StructField(c, fields[c]) for c in keys), T.StructField("at", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(postings: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        by_term: dict[str, list[tuple]] = {}
        for row in zip(postings["term"], postings["peak"], postings["positions"], postings["impacts"]):
            by_term.setdefault(row[0], []).append(row[1:])
        rows = []
        for ask in asked.itertuples(index=False):
            terms = [(w * peak, w, at, impacts) for t, w in zip(ask.terms, ask.weights) for peak, at, impacts in by_term.get(t, ())]
            best = Best(k, bits, float(ask.floor))
            best.add(int(ask.block), sorted(terms, key=lambda t: -t[0]))
            rows += [(*(getattr(ask, c) for c in keys), int(a), float(s)) for a, s in zip(*best.take())]
        return pd.DataFrame(rows, columns=out.names)

    sides = [df.repartition(parts, *place).groupBy(*place) for df in (found, asked)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, out)


class Best:
    """The best documents of a query so far, by rounded score and then number; ``floor`` is the score they have to reach."""

    def __init__(self, k: int, bits: int, floor: float = 0.0) -> None:
        self.k, self.bits, self.floor = k, bits, floor
        self.at, self.score = np.empty(0, np.int64), np.empty(0)

    def add(self, block: int, terms: list[tuple[float, float, np.ndarray, np.ndarray]]) -> None:
        """Score the documents of a block; ``terms`` (most, weight, positions, impacts) come by falling ``most``."""
        left = np.cumsum([t[0] for t in terms][::-1])[::-1]  # what this term and those behind it can add
        total = np.zeros(1 << self.bits)
        for rest, (_, weight, positions, impacts) in zip(left, terms):
            if rest + SLACK < self.floor:
                met = total[positions] > 0
                positions, impacts = positions[met], impacts[met]
            total[positions] += weight * impacts
        score = np.round(total, DIGITS)
        pick = np.flatnonzero((score > 0) & (score + SLACK >= self.floor))
        at = np.concatenate([self.at, (block << self.bits) + pick])
        score = np.concatenate([self.score, score[pick]])
        first = np.lexsort((at, -score))[: self.k]
        self.at, self.score = at[first], score[first]
        if len(first) == self.k:
            self.floor = max(self.floor, float(self.score[-1]))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        return self.at, self.score


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(
    spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, scope: list[str] | None = None, query_id: str = "query_id", query: str = "query",
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Best ``k`` documents per query (and scope): query_id, scope, doc_id, score, rank; ties by document id.

    Queries without a term of the index give no row. ``scope`` and ``bits`` are those the index was built with.
    """
    scope = scope or []
    keys = ["query_id", *scope]
    ensure_checkpoint_dir(spark)
    weights, postings = weighted_terms(spark, folder, queries, scope, query_id=query_id, query=query)
    weights = weights.checkpoint()  # three steps use them; so do the bounds two
    bounds = block_bounds(weights, postings, queries, scope).checkpoint()
    head = _first(bounds, keys, [F.desc("bound"), F.asc("block")], HEAD)
    seeds = _scored(head.withColumn("floor", F.lit(0.0)), weights, postings, scope, k, bits)
    floors = _first(seeds, keys, [F.desc("score"), F.asc("at")], k).where(F.col("rank") == k).select(*keys, F.col("score").alias("floor"))
    open_ = bounds.join(floors, keys, "left").fillna(0.0, "floor").where(F.col("bound") + SLACK >= F.col("floor"))
    found = _first(_scored(open_, weights, postings, scope, k, bits), keys, [F.desc("score"), F.asc("at")], k)
    documents = spark.read.parquet(f"{folder}/documents").select("at", "doc_id")
    return documents.join(bounded_broadcast(found, queries, max(1.0, k / 4.0)), "at").select(*keys, "doc_id", "score", "rank")
