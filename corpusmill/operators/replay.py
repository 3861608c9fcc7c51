"""Ordered replay of a stateful rule over keys of any size.

Some rules are sequential: whether a row is kept depends on which earlier rows were. A key may be
huge (one source holding a third of the corpus), so it is never given to one task. Rows are cut into
pieces by position; every piece is replayed on its own from a *guessed* starting state, and a piece
whose guess differs from what its predecessor really ended in is replayed again from that state. When no
guess differs any more, the result is the one a single sequential pass gives.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import ensure_checkpoint_dir, ship_package

# verdict(state, t, row values) -> value of the result column; state is a list that it changes in place.
Verdict = Callable[..., bool]


def piecewise_replay(
    rows: DataFrame, key: str, order: list[str], verdict: Verdict, matters: Callable[..., list], result: str, pieces: int | None = None
) -> DataFrame:
    """Apply a rule with a short memory to every key's rows in ``order``: ``rows`` with the boolean column ``result``.

    Rows are cut into pieces of about equal row counts by range of (key, order), whatever the keys: a key of a third
    of all rows becomes many pieces, and a thousand small keys share one. A piece is one pass over its rows. Only its first key can
    have begun in the piece before. The state it begins with there is taken as empty at first, and
    pieces whose predecessor ended otherwise are done again from that state, until every piece began where its predecessor
    ended. ``matters(state, first of order)`` is what of a state can still matter at a piece's first row; where that is
    nothing, as after any pause, the first pass was right. A piece that began right is stored once and never touched again. The driver sees one row per piece: its
    first and last key and the state it ended in, a list that ``verdict`` keeps short.

    ``key`` may be null, which is a key like any other. Rows equal in key and order are in any order.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order]
    cut = rows.repartitionByRange(pieces, *by).sortWithinPartitions(*by).withColumn("_piece", F.spark_partition_id()).checkpoint()
    names, fields = rows.columns, rows.schema.fields
    at_key, at_order = names.index(key), [names.index(o) for o in order]

    def run(starts: dict[int, list]) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            piece = now = first = begun = None
            state: list = []
            for batch in batches:
                keys = batch.column(at_key).to_pylist()
                values = list(zip(*(batch.column(i).to_pylist() for i in at_order)))
                said = []
                for k, v in zip(keys, values):
                    if piece is None:
                        piece, first, now, begun = batch.column(len(names))[0].as_py(), k, k, v[0]
                        state = list(starts.get(piece, []))
                    elif k != now:
                        now, state = k, []
                    said.append(verdict(state, *v))
                if said:
                    none = pa.nulls(len(said), pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.bool_()), none], [*batch.schema.names, result, "_end"])
            if piece is not None:
                end = json.dumps([str(first), first is None, str(now), now is None, state, begun], default=str)
                blank = [pa.nulls(1, batch.schema.field(i).type) for i in range(len(names))]
                cols = [*blank, pa.array([piece], pa.int32()), pa.array([None], pa.bool_()), pa.array([end])]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, result, "_end"])

        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("_piece", T.IntegerType()),
                               T.StructField(result, T.BooleanType()), T.StructField("_end", T.StringType())])
        return cut.where(F.col("_piece").isin(list(starts))).mapInArrow(step, schema) if starts else cut.mapInArrow(step, schema)

    made = run({}).checkpoint()
    told = {r["_piece"]: json.loads(r["_end"]) for r in made.where(F.col("_end").isNotNull()).select("_piece", "_end").collect()}
    used: dict[int, list] = dict.fromkeys(told, [])
    runs: list[tuple[DataFrame, set[int]]] = [(made, set(told))]
    while True:
        wanted, before = {}, None
        for p in sorted(told):  # pieces without a row have nothing to pass on
            follows = before is not None and told[p][:2] == before[2:4]
            wanted[p] = matters(before[4], told[p][5]) if follows else []
            before = told[p]
        again = {p: s for p, s in wanted.items() if s != used[p]}
        if not again:
            break
        made = run(again).checkpoint()
        told |= {r["_piece"]: json.loads(r["_end"]) for r in made.where(F.col("_end").isNotNull()).select("_piece", "_end").collect()}
        used |= again
        runs = [(df, kept - set(again)) for df, kept in runs] + [(made, set(again))]
    parts = [df.where(F.col("_end").isNull() & F.col("_piece").isin(list(kept))) for df, kept in runs if kept]
    out = parts[0] if parts else made.limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*names, result)
