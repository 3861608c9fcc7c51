import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import resampling as R
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=10, min_words=20, longest=1, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, one after the other."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    split = [features(t, longest) for _, t in docs]
    s = Counter(bucket(f) for _, fs in split for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt)))
    out = []
    for at, ((doc, _), (n, fs)) in enumerate(zip(docs, split)):
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(fs), weight, score, None, n >= min_words, at])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def result(df):
    return order(tuple(r) for r in df.collect())


@pytest.mark.parametrize("percent, longest", [(10, 1), (50, 2), (100, 3), (0, 1)])
def test_odd_rows_ties_and_runs(spark, percent, longest):
    long = "Alpha beta GAMMA élan ÉTÉ 42 " * 5
    docs = [(i % 9, long + f"w{i % 4}") for i in range(60)] + [
        (None, long), (None, long), (None, None), (100, ""), (101, " .,;"), (102, "x\x00y_z`{|}~\x7fÀ"), (103, "big " * 30_000),
    ]
    # Equal ids with equal scores only where the rows are equal, so that which of them is first cannot be seen.
    df = spark.createDataFrame([(*d, 7, True, "b") for d in docs], "doc_id long, text string, row int, fit boolean, buckets string")
    target = spark.createDataFrame([("beta gamma x",), (None,)], "text string")
    got = R.resample(df.coalesce(1), target, percent=percent, longest=longest, min_words=3)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert result(got) == order(plain(docs, ["beta gamma x", None], percent, 3, longest))
    assert result(R.resample(df.repartition(5), target, percent=percent, longest=longest, min_words=3)) == result(got)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a a a")], "doc_id long, text string")
    assert R.resample(df.limit(0), df).count() == 0
    got = result(R.resample(df, df.limit(0), percent=50, min_words=1))
    assert got == order(plain([(1, "a b c"), (2, "a a a")], [], 50, 1))


def test_cut_falls_between_rows_of_one_key(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), F.lit(5).cast("long").alias("b"), (F.col("id") * 10**15 - 4 * 10**17).alias("c"))
    want = sorted(map(tuple, rows.collect()))
    for take in (0, 1, 333, 334, 335, 700, 999, 1000, 2000):
        got = sorted(map(tuple, rows.where(R.up_to(rows, ("a", "b", "c"), take)).collect()))
        assert got == want[:take]
    ranks = [tuple(r) for r in R.ranked(rows, ("a", "b", "c")).orderBy("rank").select("a", "b", "c", "rank").collect()]
    assert ranks == [(*r, i) for i, r in enumerate(want, 1)]


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert result(R.op13_resampling(spark, DATA)) == order(plain(docs, target))
