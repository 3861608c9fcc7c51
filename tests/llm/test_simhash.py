import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
import xxhash

from corpusmill.llm import simhash
from corpusmill.llm.common import connected_components
from tests.conftest import DATA


def plain_fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= distance).tolist():
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "a", "A b\tC", "eins zwei\x0bdrei vier fünf", "x " * 300, "é É b c d e"])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(text, slice_words=3) == plain_fingerprint(text)


def test_index_links_what_brute_force_links():
    rng = random.Random(5)
    for n in (1, 2, 33, 700, 2000):
        fps = []
        while len(fps) < n:
            seed = rng.getrandbits(64)
            for _ in range(rng.choice([1, 2, 9, 150])):
                fps.append(seed)
                seed ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
        fps = list(dict.fromkeys(fps[:n]))
        got = simhash.link_similar(np.array(fps, np.uint64))
        assert got.tolist() == plain_components(fps)


def test_whole_table_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    rows = [(d["doc_id"], d["text"], "x") for d in docs]
    rows += [(10_000, None, "x"), (10_001, "", None), (10_002, " \t", "x"), (3, rows[3][1], "x"), (10_003, "word", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(df).collect())
    rows.sort(key=lambda r: r[0])
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    parts = plain_components(fps)
    assert got == [(i, f"{f:016x}", rows[p][0]) for (i, _, _), f, p in zip(rows, fps, parts)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "a b"), (1, "c d")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(lost).collect()} == {(None, None), (1, 1)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]}
    assert connected_components(df.limit(0)).count() == 0
