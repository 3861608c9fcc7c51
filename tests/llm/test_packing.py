import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing as P
from tests.conftest import DATA

PATH = P.tokenizer_path()
TOK = Tokenizer.from_file(PATH)


def plain_ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [1]


def judge(rows, docs):
    """Every id once, right check sums, gapless sequences; share of padding."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        by_doc.setdefault(doc, []).append((start, length, crc, total))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert set(by_doc) == set(docs)
    for doc, text in docs.items():
        ids = np.array(plain_ids(text), "<u4")
        at = 0
        for start, length, crc, total in sorted(by_doc[doc]):
            assert (start, total) == (at, len(ids)) and length > 0
            at += length
            assert crc == zlib.crc32(ids[start:at].tobytes())
        assert at == len(ids)
    padding = used = 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= P.WINDOW
        used += end
        padding += 0 if end & (end - 1) == 0 else P.WINDOW - end
    return padding / used


def names(df):
    return [
        tuple(r)
        for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    ]


@pytest.mark.parametrize(
    "text", ["", "a" * 3000, "<|endoftext|>x<|endoftext|", " \n \tx", "é　\x85 123 ١٢ ²", "it's 'S", "🙂 ñ" * 50]
)
def test_ids_are_the_library_ones(text):
    assert P.token_ids(text, PATH).tolist() == plain_ids(text)


def test_white_space_beyond_the_pattern():
    text = "\n" * 1_500_000 + "x"
    assert P.token_ids(text, PATH).tolist() == plain_ids(text)


def test_table_is_packed(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert judge(names(P.op10_packing(spark, DATA)), docs) < 0.02


def test_odd_rows(spark):
    texts = [None, "", " ", "a", "b " * 5000, "tail " * 20] + ["one length for all " * 300] * 60
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(t, i, 7) for i, t in docs.items()], "text string, doc_id long, offset int").repartition(5)
    assert judge(names(P.pack(df, PATH)), docs) < 0.05
    assert P.pack(df.limit(0), PATH).count() == 0
    same = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "u")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in P.pack(same, PATH).collect()) == [(0, 2), (1, 4), (1, 4)]


def test_sums_of_every_cut():
    ids = np.random.default_rng(0).integers(0, 50257, 20 * P.GRAIN).astype("<u4")
    heads, rests = P.grain_sums(ids)
    for k in range(21):
        assert heads[k] == zlib.crc32(ids[: k * P.GRAIN].tobytes())
        assert rests[k] == zlib.crc32(ids[k * P.GRAIN :].tobytes())


def test_solver_against_plain_search():
    rng = np.random.default_rng(1)
    for window in (16, 32):
        for _ in range(5):
            h = rng.integers(0, 500, window)
            h[0] = 0
            made, left = P.solve(h, window)
            used = np.zeros(window, int)
            for parts, times in made:
                assert sum(parts) == window and times > 0
                np.add.at(used, list(parts), times)
            assert (used + left == h).all() and (left >= 0).all()
            for parts, times in P.fill_greedily(left, window):
                np.subtract.at(left, list(parts), times)
            assert not left.any()
    # Non-negative least squares: gradient conditions hold at the solution.
    a, b = rng.random((12, 30)), rng.random(12)
    x = P.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-7 and np.abs(slope[x > 0]).max() < 1e-7
    assert public_tokenizers.path("byte_bpe_50k.json") == PATH
