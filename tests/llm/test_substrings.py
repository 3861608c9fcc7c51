import hashlib
import random

import numpy as np
import pytest

from corpusmill.llm import substrings as S
from tests.conftest import DATA


def plain(rows, length=50):
    """Sorted results of a search with a table of all strings; ``rows``: (id, text)."""
    seen = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for p in range(len(data) - length + 1):
                w = data[p : p + length]
                seen[w] = min(i, seen.get(w, i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        if i is not None:
            for p in range(len(data) - length + 1):
                if seen[data[p : p + length]] < i:
                    covered[p : p + length] = b"\1" * length
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(1 for j, c in enumerate(covered) if c and (j == 0 or not covered[j - 1]))
        out.append((i, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def result(df, **more):
    got = [tuple(r) for r in S.without_repeats(df, digests=True, **more).collect()]
    return sorted(got, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", range(8))
def test_index_against_plain_search(seed, monkeypatch):
    rng = random.Random(seed)
    length = rng.choice([7, 9, 15])
    monkeypatch.setattr(S, "LENGTH", length)
    letters = b"ab" if seed % 2 else b"abcd"
    texts = list({bytes(rng.choice(letters) for _ in range(rng.randrange(length, length + 9))) for _ in range(rng.randrange(2, 40))})
    owners = np.array([rng.randrange(12) for _ in texts])
    index = S.RunIndex(texts, owners)
    assert len(index.run_start) <= len(index.text)
    asked = [bytes(rng.choice(letters + b"z\0") for _ in range(rng.randrange(1, length + 9))) for _ in range(30)] + texts[:5]
    lengths, rows = index.stream(asked)
    for i, t in enumerate(asked):
        pad = lengths.shape[1] - len(t)
        for p in range(len(t)):
            longest = max(k for k in range(length + 1) if k <= len(t) - p and (k == 0 or any(t[p : p + k] in x for x in texts)))
            assert lengths[i, pad + p] == longest
            if longest == length:
                own = min(o for x, o in zip(texts, owners) if t[p : p + length] in x)
                assert index.smallest_owner(rows[i, [pad + p]])[0] == own
    for t, o, got in zip(texts, owners, S.repeated_starts(texts, np.zeros(len(texts), int), owners)):
        want = [p for p in range(len(t) - length + 1) if any(t[p : p + length] in x and y < o for x, y in zip(texts, owners))]
        assert got.tolist() == want


def test_phrases_cover_every_string_once():
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 10, 49, 50, 51, 200, 3000)] + [np.full(500, 97, np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    _, _, start, length = S.phrases(np.concatenate(texts), ends)
    strings = sorted(s + k for s, n in zip(start.tolist(), length.tolist()) for k in range(n - S.LENGTH + 1))
    assert strings == [b + k for b, t in zip([0, *ends], texts) for k in range(len(t) - S.LENGTH + 1)]


def _corpus(rng):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages)[rng.randrange(30) :][: rng.randrange(30, 400)] for _ in range(rng.randrange(4))]
        parts += [" ".join(rng.choice(words) for _ in range(rng.randrange(40)))]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(200, "ab" * 3000), (201, "ba" * 2000), (202, "x" * 49), (203, "x" * 50), (204, "x" * 51), (205, "\0" * 60), (206, "\0" * 70)]
    rows += [(300, None), (301, ""), (None, rows[5][1]), (None, None), (5, rows[5][1]), (7, rows[9][1]), (401, rows[3][1] * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("wide,lot,slice_,gather", [(2048, 1 << 20, 1 << 20, 16 << 20), (2, 500, 300, 1000)])
def test_corpora_with_odd_rows(spark, monkeypatch, wide, lot, slice_, gather):
    for name, value in (("SLICE", slice_), ("GATHER", gather)):
        monkeypatch.setattr(S, name, value)
    rows = _corpus(random.Random(wide))
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, print int").repartition(3)
    assert result(df, wide=wide, lot=lot) == plain(rows)


def test_empty_and_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert S.without_repeats(docs.limit(0)).count() == 0
    got = sorted(tuple(r) for r in S.op1_repeated_passages(spark, DATA).collect())
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_text_is_asked_for_only_where_a_side_agrees(spark):
    """Phrases of one anchor whose surroundings differ on both sides cannot share a string of 50 bytes and are not fetched."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    grams = [word(20) for _ in range(40)]  # holds some anchor of 16 bytes, but no string of 50
    rows = [(i, " ".join(word(30) + g for g in rng.sample(grams, 20))) for i in range(60)]
    shared = word(120)
    rows += [(100, word(200) + shared), (101, word(150) + shared + word(150))]
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    asked = S._parsed(S._texts(df, "doc_id", "text"), 3, S.WIDE).where("key is not null")
    assert {r.doc for r in asked.select("doc").collect()} <= {100, 101}
    assert result(df) == plain(rows)


def test_a_wide_anchor_is_split_by_sides_without_loss(spark):
    """More phrases of one anchor than one lot takes, which agree to the left, to the right or nowhere."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    middle, lefts, rights = word(16), [word(40) for _ in range(4)], [word(40) for _ in range(4)]
    rows = [(i, word(30) + rng.choice([*lefts, word(40)]) + middle + rng.choice([*rights, word(40)]) + word(30)) for i in range(80)]
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    assert result(df, wide=3, lot=300) == result(df, wide=30, lot=3000) == plain(rows)
