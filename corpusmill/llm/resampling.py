"""Importance resampling towards a target distribution: array-scored weights, a bisected threshold, range-partitioned ranks.

Documents and targets are bags of hashed word runs. The gain of a bucket is the logarithm of its share in the
target over its share in the corpus; a document's weight is the sum of its gains, and Gumbel noise drawn
from its id turns the highest scores into a sample without replacement in proportion to exp(weight / 1000).

1. Every text is split once. Its buckets are stored as an array, with a number for the row.
2. Buckets are counted (10,000 rows at most, combined before the shuffle), and the array of gains is looked
   up by every document in its own array of buckets.
3. The cut is found by bisection over the stored scores: exact counts of the rows on either side of a
   threshold, several halvings in one job. Among rows tied at the threshold, ids are bisected in the same
   way, and then row numbers, so that the cut always falls between two rows.
4. Only the rows above the cut are partitioned by range and sorted; a rank is a row's place in its part
   plus the rows of the parts before. No row is joined with anything.

A third of all rows with one id, one text or one score changes nothing: row numbers split them everywhere.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, table, text_of
from corpusmill.session import ship_package

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Halvings of an interval counted in one job (15 thresholds).
HALVINGS = 4
LAST = 2**63 - 1


#: Bytes of a text to bytes of words: A-Z becomes a-z, all other ASCII but digits and a-z a space; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def feature_hashes(text: str, longest: int) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC-32 of each run of 1 to ``longest`` consecutive words, joined by one space."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    found = words
    for k in range(2, longest + 1):
        found = found + [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len(words), np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


def hashed(rows: DataFrame, text_col: str, longest: int, buckets: int, id_col: str | None = None) -> DataFrame:
    """row (a number), id, n_words, and ``buckets``: the bucket of each feature of a row."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [feature_hashes(t.as_py() or "", longest) for t in batch.column(2)]
            ends = np.cumsum([0, *(len(h) for _, h in made)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *(h for _, h in made)]) % np.uint32(buckets)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            cols = [batch.column(0), batch.column(1), pa.array([n for n, _ in made], pa.int32()), arrays]
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "n_words", "buckets"])

    given = rows.select(
        F.monotonically_increasing_id().alias("row"), (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("id"),
        text_of(text_col).alias("text"),
    )
    return given.mapInArrow(run, "row long, id long, n_words int, buckets array<int>")


def bucket_counts(features: DataFrame) -> dict[int, int]:
    """Features by bucket; one row per bucket reaches the driver."""
    counted = features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r.bucket: r.n for r in counted.collect()}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all)))
        for b in range(buckets)
    ]


def _noise(id_col: str, seed: int) -> Column:
    """floor(1000 * Gumbel), from 32 bits of a digest of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def up_to(rows: DataFrame, keys: Sequence[str], take: int) -> Column:
    """Condition that holds for the first ``take`` rows of ``rows`` by ``keys`` (long, not null, ascending, unique together).

    One key after the other: the smallest value with ``take`` rows up to it, by exact counts at the inner
    points of the next ``HALVINGS`` halvings; then the next key among the rows tied there.
    """
    if take <= 0:
        return F.lit(False)
    chosen, tied, need = F.lit(False), F.lit(True), take
    for name in keys:
        key, among = F.col(name), rows.where(tied)
        low, high, n = among.agg(F.min(key), F.max(key), F.count("*")).first()
        if n <= need:
            return chosen | tied
        while low < high:
            step = max(1, (high - low + 1) >> HALVINGS)
            points = [low + step * i - 1 for i in range(1, 1 << HALVINGS) if low + step * i - 1 < high]
            counts = among.agg(*(F.count(F.when(key <= F.lit(p), 1)) for p in points)).first()
            # The first point with enough rows up to it ends the interval, the one before starts it.
            at = next((i for i, c in enumerate(counts) if c >= need), len(points))
            low, high = (points[at - 1] + 1 if at else low), (points[at] if at < len(points) else high)
        cut = F.lit(low)
        need -= among.where(key < cut).count()
        chosen, tied = chosen | (tied & (key < cut)), tied & (key == cut)
    return chosen | tied


def ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``rank`` from 1 by ``keys``: parts by range, places within them, and the rows of the parts before."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    before, offsets = 0, []
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row per part
        offsets.append((r["_part"], before + 1))
        before += r.n
    first = spark.createDataFrame(offsets, "_part long, _first long")
    return (
        placed.join(F.broadcast(first), "_part")
        .withColumn("rank", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_first")
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = 1,
    buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null: not drawn).

    Drawn are the ``percent`` per cent (rounded down) of the rows with ``min_words`` words or more that have the highest scores; ties
    go to the smaller id. A null or empty text has no feature and weight 0. A null id is hashed
    as an empty string and comes last among ties; rows that repeat an id are rows of their own, in the order in which
    they were read. An empty target has no feature: gains then only depend on the corpus. An empty table gives
    an empty result. Other columns are not looked at.
    """
    features = stored(hashed(docs, text_col, longest, buckets, id_col))
    gains = gains_of(bucket_counts(features), bucket_counts(hashed(target, target_text_col, longest, buckets)), buckets)
    # A constant array: folded once, then looked up by position.
    gain = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<long>")
    scored = features.select(
        "row", "id", F.size("buckets").cast("long").alias("n_features"), (F.col("n_words") >= min_words).alias("fit"),
        F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(gain, b)).alias("weight"),
    )
    scored = stored(
        scored.withColumn("score", F.col("weight") + _noise("id", seed))
        .withColumn("order", -F.col("score")).withColumn("tie", F.coalesce("id", F.lit(LAST)))
    )
    keys = ("order", "tie", "row")
    fit = scored.where("fit")
    drawn = F.col("fit") & up_to(fit, keys, fit.count() * percent // 100)
    out = ("id", "n_features", "weight", "score", "rank")
    return (
        ranked(scored.where(drawn), keys).select(*out)
        .unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*out))
        .withColumnRenamed("id", "doc_id")
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: DuckDB has no CRC-32: its table is built from the polynomial, once per distinct word.
OP13_SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, unused: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps
),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
  FROM documents
),
goals AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM benchmark
),
used AS (SELECT r, unnest(words) AS w FROM docs),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
              lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b
  FROM (SELECT w FROM used UNION SELECT w FROM goals), crc
),
s AS (SELECT b, count(*) AS s FROM used JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM goals JOIN bucket USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM used) + {BUCKETS})::DOUBLE
             / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM goals) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (b)
),
weighed AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM used JOIN bucket USING (w) JOIN gain USING (b) GROUP BY r
),
scored AS (
  SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (r)
),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""
