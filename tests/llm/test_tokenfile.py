import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import tokenfile as T
from corpusmill.llm.packing import tokenizer_path
from tests.conftest import DATA


def plain(rows):
    """(doc_id, start, n_tokens, crc) by the library, in ascending order of ids."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    made = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END], "<u4")
        made.append((doc, zlib.crc32(ids.tobytes()), ids))
    out, start = [], 0
    for doc, crc, ids in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.append((doc, start, len(ids), crc))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (2 ** (rng.random(n) * 32)).astype(np.uint32)
    ranks[: min(n, 4)] = [255, 256, 0xFFFFFF, 0x1000000][: min(n, 4)]
    control, data = T.pack_ranks(ranks)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
    assert (T.unpack_ranks(control, data, n) == ranks).all()
    docs = [None, 7][: min(n, 2)]
    lengths = np.array([n] if len(docs) == 1 else [1, n - 1] if docs else [], np.int64)
    raw = T.file_bytes(docs, lengths, ranks)
    again = T.file_content(raw)
    assert again[0] == docs and (again[1] == lengths).all() and (again[2] == ranks).all()
    for broken in (raw[:-1] if n else raw + b"x", b"other" + raw[5:], raw[:20]):
        with pytest.raises(ValueError):
            T.file_content(broken)


def test_odd_rows_and_files(spark, tmp_path):
    rows = [
        (5, "the cat"), (5, "a cat"), (5, "the cat"), (None, "no id"), (None, None), (-3, ""), (9, None), (2, "word " * 40_000), (1, "é 日本 <|endoftext|> x"),
    ]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "doc_id long, text string, ids string, row int, n int")
    folder = f"file:{tmp_path}/tokens"
    T.write_tokens(df.repartition(3), folder, tokenizer_path(), file_ids=5)
    stray = T.file_bytes([77], np.array([1]), np.array([0], np.uint32))
    T._put(folder, "000000-000000-stray.ids", stray)  # what a lost attempt leaves behind
    got = sorted((tuple(r) for r in T.read_tokens(spark, folder, digests=True).collect()), key=lambda r: r[1])
    assert got == plain(rows)
    whole = {r.start: r for r in T.read_tokens(spark, folder).collect()}
    assert all(zlib.crc32(np.array(whole[s].ids, "<u4").tobytes()) == crc and len(whole[s].ids) == n for _, s, n, crc in got)
    assert sum(name.endswith(".ids") for name in os.listdir(tmp_path / "tokens")) > 2
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert {r.n_bytes for r in manifest.collect()} == {os.path.getsize(tmp_path / "tokens" / r.name) for r in manifest.collect()}
    counts = np.bincount(np.concatenate([r.ids for r in whole.values()]))
    by_rank = np.frombuffer((tmp_path / "tokens" / "ranks").read_bytes(), "<u4")
    assert by_rank.tolist() == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_empty_table_and_given_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    T.write_tokens(docs.limit(0), f"file:{tmp_path}/none", tokenizer_path())
    assert T.read_tokens(spark, f"file:{tmp_path}/none").count() == 0
    got = sorted(tuple(r) for r in T.op12_token_files(spark, DATA).collect())
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
