"""Helpers shared by the training-data operators: stored tables, connected components, running folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import ensure_checkpoint_dir

#: The six white-space characters of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def gone_at_end(spark: SparkSession, folder: str) -> None:
    """Have an existing folder removed when the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` but keeps columns compressed. Every executor can read
    the files, so a lost executor costs only the task it was running. The files go when the session ends.
    """
    spark = df.sparkSession
    target = shared_folder(spark, "table")
    df.write.parquet(target, compression=compression)
    gone_at_end(spark, target)
    return spark.read.schema(df.schema).parquet(target)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, step: Callable[[DataFrame], DataFrame], named: dict[str, str], added: Sequence[str] = ()) -> DataFrame:
    """Apply ``step`` to the columns that it needs (``named``: its name for each) and return the columns of ``docs`` as they were.

    All other columns travel as one struct, so no name of theirs meets a name that the step uses. Columns ``added`` by the
    step come last and replace input columns of these names. A needed column that the step drops is not returned.
    """
    theirs, new = set(named.values()), {a.lower() for a in added}
    others = [c for c in docs.columns if c not in theirs and c.lower() not in new]
    rest = F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(0)
    made = step(docs.select(*(F.col(quoted(c)).alias(n) for n, c in named.items()), rest.alias("_rest")))
    back = {c: F.col(n) for n, c in named.items() if n in made.columns and c.lower() not in new}
    back |= {c: F.col(f"_rest.c{i}") for i, c in enumerate(others)}
    return made.select(*(back[c].alias(c) for c in docs.columns if c in back), *added)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest_number(key: Column) -> Column:
    """The first 60 bits of the MD5 of a string: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def with_running(df: DataFrame, values: str, out: str, fold: Callable[[Column, Column], Column], zero: Column, block: int = 128) -> DataFrame:
    """Add ``out``: the fold of all earlier elements, for every element of the array column ``values`` (exclusive scan).

    Blocks of ``block`` elements are folded first, so an array of n elements costs about
    n * block + (n / block)^2 steps instead of n^2. Every intermediate array is a column of its own which is
    referred to twice: the optimizer then leaves it where it is, and no lambda computes it again per element.
    """
    blocks, heads = f"{out}_blocks", f"{out}_heads"
    last = F.greatest(F.ceil(F.size(values) / block).cast("int") - 1, F.lit(0))
    return (
        df.withColumn(blocks, F.transform(
            F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(values, b * block + 1, F.lit(block)), zero, fold)
        ))
        .withColumn(heads, F.transform(blocks, lambda _, i: F.aggregate(F.slice(blocks, F.lit(1), i), zero, fold)))
        .withColumn(out, F.transform(values, lambda _, i: F.aggregate(
            F.slice(values, (i - i % block) + 1, i % block),
            F.coalesce(F.get(heads, F.floor(i / block).cast("int")), F.get(heads, F.lit(0))),
            fold,
        )))
        .drop(blocks, heads)
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (long columns ``a`` and ``b``).

    Alternating large-star and small-star steps: each shrinks every neighbourhood to a star around
    its smallest node, so the number of rounds is logarithmic in the length of the longest chain. A
    round is joins and minimum aggregates on (node, node) rows, stored before the next. Hubs are
    only ever aggregated (combined before the shuffle) or joined (split by adaptive execution).
    Returns ``node`` and ``component``, without nodes that have no edge to another node.
    """
    state = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        ).distinct()
        state = stored(small)
        # Sums of hashes change whenever an edge does; equal twice in a row means that every star is closed.
        mark = state.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class Forest:
    """Connected pieces of numbered items; ``label`` is the smallest number of a piece."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            low, high = np.minimum(x, y), np.maximum(x, y)
            # Each higher label moves to the smallest label that meets it; then every chain is followed to its end.
            new = np.arange(len(self.label))
            np.minimum.at(new, high, low)
            while True:
                further = new[new]
                if (further == new).all():
                    break
                new = further
            self.label = new[self.label]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
