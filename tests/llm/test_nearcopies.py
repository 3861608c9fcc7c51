import random

import numpy as np

import corpus_pipeline
from corpusmill.llm import nearcopies as N

SCHEMA = "doc_id long, text string, lang string"


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_stay(rows):
    sets = [plain_set(t) for _, t, _ in rows]
    parts = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if None not in (rows[i][0], rows[j][0]) and len(a & b) / len(a | b) >= 0.8 and parts[i] != parts[j]:
                x, y = parts[i], parts[j]
                parts = [x if p == y else p for p in parts]
    low = {}
    for p, r in zip(parts, rows):
        low[p] = min(low.get(p, r[0] or 0), r[0] or 0)
    return sorted(((r[0] or -1), r[1] or "") for p, r in zip(parts, rows) if r[0] is None or r[0] == low[p])


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(150)]
        for copy in range(12):
            text = list(base)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(len(text))] = word()
            rows.append((rng.randrange(10**6), " ".join(text), "en"))
    rows += [(None, rows[0][1], "en"), (7, None, "en"), (8, " ", "en"), (9, "a b", "en"), (10, "A  B", "en"), (11, "a b c", "en")]
    rows += [(rows[5][0], "another text under an id that is there already", "en")]
    return rows


def judged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = corpus_pipeline.near(spark, df, "")
    assert out.columns == df.columns
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in out.collect())


def test_stage_against_all_pairs(spark):
    rows = corpus(1)
    want = plain_stay(rows)
    assert 20 < len(want) < 130
    assert judged(spark, rows) == want


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 500)
    rows = corpus(2)
    assert judged(spark, rows) == plain_stay(rows)


def test_the_index_of_fingerprints_gives_candidates(spark, monkeypatch):
    """Pairs within four bits come from op4's index and are verified like all others: without a bucket they are found still."""
    monkeypatch.setattr(N, "bands", lambda found: np.arange(1, 3) * np.int64(2) + np.int64(found.sum() >> np.uint64(1)))
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(1, " ".join(base), "en"), (2, " ".join([*base[:-1], "other"]), "en"), (3, " ".join(reversed(base)), "en")]
    assert N.simhash._bits(np.uint64(N.simhash.fingerprint(rows[0][1]) ^ N.simhash.fingerprint(rows[1][1]))) <= N.simhash.DISTANCE
    assert [i for i, _ in judged(spark, rows)] == [1, 3]


def test_threshold_is_exact():
    assert N.similar(8, 9, 9) and not N.similar(7, 8, 9) and N.similar(4, 4, 5) and not N.similar(79, 89, 89)
    sets = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 11, 22, 40)]
    assert sorted(map(sorted, N.link_members(np.arange(4), sets))) == [[0, 1], [1, 2]]


def test_a_text_of_many_slices_has_one_set():
    words = [f"w{i}" for i in range(3000)]
    assert len(N.shingles(" ".join(words))) == 2996
    assert np.array_equal(N.shingles(" ".join(words).upper()), N.shingles("\t".join(words)))
