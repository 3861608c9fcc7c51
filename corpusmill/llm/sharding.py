"""Sharding through a permutation-filled lookup table; DataFrame functions only.

Each shard has its own permutation of the slots of a prime-sized table: from ``offset`` on in steps
of ``skip``. The shards take turns; at its turn a shard claims the first slot of its permutation
which is still free, until the table is full. Every shard then owns the same number of slots, give
or take one, and when a shard is removed hardly any slot moves between the others. A row's key is
hashed to a slot, and a broadcast of the table (a fixed number of rows, whatever the data) gives the
shard in constant time, without any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import carried, digest_number, table

#: Slots: prime, and over a hundred for each shard, so that no shard owns one per cent more than another.
SLOTS = 2053
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: The table is broadcast, so its size has a bound of its own.
MAX_SLOTS = 1_000_003


def _number(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for every slot. ``slots`` must be prime and not below the number of shards.

    Repeated shard names are an error, as they would claim by the same permutation.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and there must be one at least")
    if not len(shards) <= slots <= MAX_SLOTS or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, at least 3 and the number of shards, and within the bound")
    start = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner, at, free = [-1] * slots, list(start), slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def shard_rows(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS, key_col: str = "doc_id") -> DataFrame:
    """Add ``slot`` and ``shard`` to the rows of ``docs``.

    A null key counts as an empty string. Equal keys always meet in one shard; repeated rows stay. An
    input column named ``slot`` or ``shard``, in any case, is replaced; all others keep their names and values. Nothing but the key is read to place a row.
    """
    owner = fill_table(shards, slots)
    spark = docs.sparkSession
    lookup = (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("_slot", "_owner"))
        .select("_slot", F.get(F.split(F.lit("\n".join(shards)), "\n"), F.col("_owner").cast("int")).alias("_shard"))
    )
    def step(rows: DataFrame) -> DataFrame:
        key = F.coalesce(F.col("key").cast("string"), F.lit(""))
        placed = rows.withColumn("_at", F.pmod(digest_number(key), F.lit(slots)).cast("int"))
        joined = placed.join(F.broadcast(lookup), F.col("_at") == F.col("_slot"), "left")
        return joined.select("key", "_rest", F.col("_at").alias("slot"), F.col("_shard").alias("shard"))

    return carried(docs, step, {"key": key_col}, ["slot", "shard"])


def op3_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"))


OP3_SQL = f"""
WITH RECURSIVE prefs AS (
  SELECT list(('0x' || substr(md5('offset:' || s), 1, 15))::BIGINT % {SLOTS} ORDER BY s) AS start,
         list(('0x' || substr(md5('skip:' || s), 1, 15))::BIGINT % {SLOTS - 1} + 1 ORDER BY s) AS step
  FROM (SELECT printf('shard-%02d', i) AS s FROM range({len(SHARDS)}) AS r(i))
),
turns(turn, open, slot) AS (
  SELECT -1, [true FOR j IN range({SLOTS})], NULL::BIGINT
  UNION ALL
  SELECT turn + 1, open[:pick] || [false] || open[pick + 2:], pick
  FROM (
    SELECT turn, open,
           [x FOR x IN [(start[(turn + 1) % {len(SHARDS)} + 1] + j * step[(turn + 1) % {len(SHARDS)} + 1]) % {SLOTS}
                        FOR j IN range({SLOTS})] IF open[x + 1]][1] AS pick
    FROM turns, prefs WHERE turn + 1 < {SLOTS}
  )
)
SELECT d.doc_id, d.n_chars, t.slot, printf('shard-%02d', t.turn % {len(SHARDS)}) AS shard
FROM documents d
JOIN turns t ON t.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS}
"""
