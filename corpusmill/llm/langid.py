"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its letter n-grams, hashed to ``BUCKETS`` rows; a linear
layer and a softmax give a probability per language. Embeddings and layer are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled documents. Part of the sample
is set aside to calibrate the probabilities by one temperature; a prediction whose calibrated
probability is lower than that of nearly all right ones on texts of that size is rejected. As averaging and the layer are linear, every bucket's
embedding is multiplied with the layer once, and predicting is one table look-up per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.llm.common import table
from corpusmill.session import ship_package

BITS = 18
BUCKETS = 1 << BITS
DIM = 16
ORDERS = (2, 3, 4)
#: The training sample: so many documents per language (by a hash of their id), of so many most frequent languages.
PER_LANGUAGE = 400
LANGUAGES = 100
#: From each sampled document: its whole text, and so many pieces of so many n-grams, spread evenly over it.
PIECES, PIECE = 4, 240
EPOCHS = 6
RATE = 0.5
#: A prediction is rejected below the probability that all but one in a thousand right calibration examples reach, and below
#: so many times what guessing gives. See ``thresholds``.
GUESS, LOST = 1.15, 0.001
#: A text is also rejected if its share of n-grams met in training is below so much of what right calibration examples have.
FAMILIAR = 0.6
UNKNOWN = "und"
_SLICE = 1 << 20  # code points hashed at once; the end of a slice counts as the end of a text


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a whole text, slice by slice; nothing if it has no letter.

    Letters are lower-cased; each run of other characters is one space, as are both ends of the text.
    """
    text, letter = (text or "").lower(), _letters()
    for at in range(0, len(text), _SLICE):
        code = np.frombuffer(text[at : at + _SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.concatenate(([32], np.where(letter[code], code, 32), [32])).astype(np.uint32)
        code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
        if len(code) < 2:
            continue
        grams = []
        for n in ORDERS:
            size = len(code) - n + 1
            if size < 1:
                continue
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h ^= code[k : k + size]
                h *= np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            grams.append(h >> np.uint32(32 - BITS))
        yield np.concatenate(grams)


def bags(text: str | None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, shares, number of n-grams) of a whole text and of pieces of it, as training examples of bounded size."""
    total, order = np.zeros(BUCKETS, np.int64), []
    for part in buckets(text):
        total += np.bincount(part, minlength=BUCKETS)
        n = len(part) // len(ORDERS)  # the same stretch of the text stands in each order's part
        for at in np.linspace(0, max(0, n - PIECE // len(ORDERS)), PIECES).astype(int).tolist():
            order.append(np.concatenate([part[o * n + at : o * n + at + PIECE // len(ORDERS)] for o in range(len(ORDERS))]))
    examples = [total] if total.any() else []
    step = max(1, len(order) // PIECES)
    out = []
    for x in examples:
        where = np.flatnonzero(x)
        out.append((where.astype(np.uint32), (x[where] / x.sum()).astype(np.float32), int(x.sum())))
    for x in order[::step][:PIECES]:
        where, count = np.unique(x, return_counts=True)
        out.append((where.astype(np.uint32), (count / count.sum()).astype(np.float32), len(x)))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embedding times layer
    bias: np.ndarray
    temperature: float
    reject: tuple[np.ndarray, np.ndarray]  # sizes, and the least probability at each; in between by the logarithm
    known: np.ndarray  # (BUCKETS,): met in training
    familiar: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, rejected?"""
        if not self.languages or not _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return UNKNOWN, 0.0, True
        total, n, met = np.zeros(len(self.languages)), 0, 0
        for part in buckets(text):
            total += self.table[part].sum(axis=0, dtype=np.float64)
            met += int(np.count_nonzero(self.known[part]))
            n += len(part)
        p = _softmax((total / max(1, n) + self.bias) / self.temperature)
        best = int(np.argmax(p))
        score = float(p[best])
        return self.languages[best], score, score < self.least(n) or met < self.familiar * n


    def least(self, n: int) -> float:
        return float(np.interp(np.log(max(1, n)), np.log(self.reject[0]), self.reject[1]))


def thresholds(p: np.ndarray, size: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in n-grams and the least probability accepted at each, from right calibration examples.

    Long texts are judged by the long examples and pieces by the pieces, as a piece is never as certain as a document.
    Towards a single n-gram the threshold falls to ``floor``, which also holds where there are no examples.
    """
    points = [(1.0, floor)]
    for these in (size <= PIECE, size > PIECE):
        if these.any():
            points.append((max(float(np.median(size[these])), points[-1][0] + 1), max(floor, float(np.quantile(p[these], LOST)))))
    return np.array([x for x, _ in points]), np.array([y for _, y in points])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[int, np.ndarray, np.ndarray, bool, int]], languages: list[str], seed: int = 0) -> Model:
    """Fit on (language number, buckets, shares, for calibration?, number of n-grams)."""
    rng, k = np.random.default_rng(seed), len(languages)
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    seen = np.zeros(BUCKETS, bool)
    layer, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    layer += rng.standard_normal((DIM, k)).astype(np.float32) * 0.1
    fit = [e for e in examples if not e[3]]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)).tolist():
            y, where, share, *_ = fit[i]
            mean = share @ emb[where]
            g = _softmax(mean @ layer + bias)
            g[y] -= 1
            back = layer @ g
            layer -= rate * np.outer(mean, g)
            bias -= rate * 0.1 * g
            # Shares are small, so embeddings take longer steps than the layer.
            emb[where] -= rate * 10 * share[:, None] * back[None, :]
            seen[where] = True
    emb[~seen] = 0  # n-grams that were never met say nothing
    logits = np.array([s @ emb[w] @ layer + bias for _, w, s, c, _ in examples if c])
    truth = np.array([y for y, _, _, c, _ in examples if c], int)
    temperature = 1.0
    if len(truth):
        scales = np.geomspace(0.05, 5, 90)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in scales]
        temperature = float(scales[int(np.argmin(loss))])
    floor, familiar = GUESS / max(1, k), 0.0
    p, right, size = np.zeros(0), np.zeros(0, bool), np.array([n for *_, c, n in examples if c], int)
    if len(truth):
        said = _softmax(logits / temperature)
        p, right = said[np.arange(len(truth)), truth], said.argmax(axis=1) == truth
        familiar = FAMILIAR * float(np.quantile([s[seen[w]].sum() for _, w, s, c, _ in examples if c], LOST))
    reject = thresholds(p[right], size[right], min(0.5, floor))
    return Model(
        languages, (emb @ layer).astype(np.float32), bias.astype(np.float64), temperature, reject, seen, familiar
    )


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from: remainder 1 of the CRC-32 of the id as text (null: empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the sample of ``docs``; held-out rows and rows without text or language are never read for it."""
    ship_package(docs.sparkSession)
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    # The smallest hashes of a quarter of the ids, then of all: no task orders more than a few thousand rows of one language.
    # Rows that repeat an id share a rank and count once. PER_LANGUAGE * LANGUAGES ids come out at most.
    ids = rows.select("id", "lang").withColumn("h", F.xxhash64("id")).withColumn("quarter", F.pmod("h", F.lit(4)))
    ids = ids.join(F.broadcast(common), "lang", "left_semi")
    by_quarter, by_hash = Window.partitionBy("lang", "quarter").orderBy("h", "id"), Window.partitionBy("lang").orderBy("h", "id")
    few = ids.withColumn("n", F.dense_rank().over(by_quarter)).where(F.col("n") <= PER_LANGUAGE).select("id", "lang", "h").distinct()
    picked = few.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= PER_LANGUAGE).drop("h")
    sample = rows.join(F.broadcast(picked), ["id", "lang"]).groupBy("lang", "n").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(lang, n, i, w.tobytes(), s.tobytes(), size) for i, (w, s, size) in enumerate(bags(text))]
            cols = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["lang", "n", "i", "w", "s", "size"])

    made = sample.select("lang", "n", "text").mapInArrow(run, "lang string, n int, i int, w binary, s binary, size long").collect()
    languages = sorted({r.lang for r in made})
    number = {x: i for i, x in enumerate(languages)}
    examples = [
        (number[r.lang], np.frombuffer(r.w, np.uint32), np.frombuffer(r.s, np.float32), r.n % 5 == 0, r.size)
        for r in sorted(made, key=lambda r: (r.lang, r.n, r.i))
    ]
    return train(examples, languages)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns and ``lang_pred``, ``score`` and ``rejected`` from whole texts.

    A null text or one without a letter is ``und`` with score 0, and rejected. Rows are judged one by
    one, so repeated rows and null ids need no rule. Input columns of these three names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    kept = docs.drop("lang_pred", "score", "rejected")
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in new)])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sent.value.predict(t.as_py()) for t in batch.column(at)]
            added = [
                pa.array([lang for lang, _, _ in said], pa.string()),
                pa.array([score for _, score, _ in said], pa.float64()),
                pa.array([rejected for _, _, rejected in said], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(batch.columns + added, [*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    said = identify(docs.select("doc_id", "text"), model)
    return said.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
