import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import similarity as S
from corpusmill.operators import dedup


def pair_rule(a, b):
    """The rule spelled out, for comparison."""
    if a == b:
        return True
    if min(len(a), len(b)) / max(len(a), len(b)) < 0.6:
        return False

    def grams(s):
        s = s.replace(" ", "")
        return {s[i : i + 3] for i in range(max(1, len(s) - 2))}

    ga, gb = grams(a), grams(b)
    return len(ga & gb) / len(ga | gb) >= 0.88 or SequenceMatcher(None, a, b).ratio() >= 0.92


def sequential(texts, gate):
    kept, seen = [], []
    for i, t in enumerate(texts):
        if t in seen or any(abs(len(t) - len(k)) <= gate and pair_rule(k, t) for k in seen[-30:]):
            continue
        kept.append(i)
        seen.append(t)
    return kept


def noisy_texts(n, seed, length=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "mu", "nu", "xi", "pi"]
    base = [" ".join(rng.choice(words) for _ in range(length // 6)) for _ in range(max(3, n // 6))]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8, 20])):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        out.append(" ".join("".join(t).split()))
    return out


def test_greedy_pass_matches_brute_force():
    for seed in range(4):
        for length in (60, 300):
            texts = noisy_texts(80, seed, length)
            assert S.greedy_positions(texts, 200) == sequential(texts, 200)


def test_jaccard_cases(spark):
    cases = [("a", "", 0.0), ("abc d", "abc d", 1.0), ("ab", "ab c", 0.0), ("abcd", "abce", 1 / 3)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r[0] for r in df.select(S.jaccard(F.col("a"), F.col("b"))).collect()]
    assert [round(g, 6) for g in got] == [round(w, 6) for _, _, w in cases]


def test_length_ratio_boundary(spark):
    df = spark.createDataFrame([("x" * 59, "x" * 100), ("x" * 60, "x" * 100)], "a string, b string")
    assert [r[0] for r in df.select(S.length_compatible(F.col("a"), F.col("b"))).collect()] == [False, True]


def test_segments_give_the_sequential_result(spark):
    rows = []
    for group, seed in (("hot", 1), ("cold", 2)):
        texts = noisy_texts(150 if group == "hot" else 20, seed)
        rows += [(group, i, t) for i, t in enumerate(texts)]
    # A copy of a text whose first occurrence is a near duplicate, far behind it.
    rows.append(("hot", 150, rows[5][2]))
    df = spark.createDataFrame(rows, "g string, pos long, text string")
    got = {(r.g, r.pos) for r in dedup.fuzzy_dedup(df, ["g"], "pos", gate=400, segment_rows=25).collect()}
    want = set()
    for g in ("hot", "cold"):
        mine = [r for r in rows if r[0] == g]
        want |= {(g, mine[i][1]) for i in sequential([r[2] for r in mine], 400)}
    assert got == want


def test_few_segments_are_replayed(spark, monkeypatch):
    """Four times the same texts: after the first time nearly all are copies, so states reach far back."""
    texts = noisy_texts(120, 5) * 4
    df = spark.createDataFrame([("hot", i, t) for i, t in enumerate(texts)], "g string, pos long, text string")
    tables, stored = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda rows: tables.append(stored(rows)) or tables[-1])
    got = sorted(r.pos for r in dedup.fuzzy_dedup(df, ["g"], "pos", gate=400, segment_rows=12).collect())
    assert got == sequential(texts, 400)
    assert len(tables) <= 36  # three of a round: 11 rounds, where each of the 40 segments could need its own
    assert {r.g: r["count"] for r in tables[0].groupBy("g").count().collect()} == {"hot": len(texts)}  # texts are stored once
    assert all("_n" not in t.columns for t in tables[1:])


def test_exact_dedup_keeps_first_of_many_copies(spark):
    df = spark.createDataFrame([(i, "Same, text!" if i % 3 else f"own {i}") for i in range(60)] + [(99, " !")], "id long, text string")
    kept = sorted(r.id for r in dedup.exact_dedup(df, "id").collect())
    assert kept == sorted([1] + list(range(0, 60, 3)))


def test_dense_position_over_ranges(spark):
    df = spark.createDataFrame([("a", 5), ("a", 250), ("a", 251), ("b", 7), ("a", 900)], "g string, o long")
    got = {(r.g, r.o): r.position for r in dedup.dense_position(df, ["g"], "o", 100).collect()}
    assert got == {("a", 5): 0, ("a", 250): 1, ("a", 251): 2, ("a", 900): 3, ("b", 7): 0}


def test_near_pairs_match_all_pairs_in_reach(spark):
    texts = noisy_texts(90, 3)
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, pos long, text string")
    got = {(r.first_id, r.second_id) for r in dedup.near_pairs(df, ["g"], "pos", "pos", look_back=10, threshold=0.7).collect()}
    want = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, min(len(texts), i + 11)):
            ga, gb = ({s.replace(" ", "")[k : k + 3] for k in range(len(s.replace(" ", "")) - 2)} for s in (a, texts[j]))
            if len(ga & gb) / len(ga | gb) >= 0.7:
                want.add((i, j))
    assert got == want and want


def plain_greedy(norms, gate):
    kept = []
    for i, new in enumerate(norms):
        recent = [norms[j] for j in kept[-30:]]
        if new and new not in [norms[j] for j in kept] and not any(abs(len(t) - len(new)) <= gate and pair_rule(t, new) for t in recent):
            kept.append(i)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_bounds_by_bins_change_no_verdict(seed):
    rng = random.Random(seed)
    letters = ["ab ", "abcdefgh ", "aăâbcdđeêghiklmnoôơ   ", "abc \U0010fffd\U00020000 "][seed]
    norms = ["", "a", "ab", "a b", "abc", "a b c"]
    for _ in range(12):
        base = "".join(rng.choice(letters) for _ in range(rng.choice([4, 30, 120, 400, 900])))
        for _ in range(4):
            cut = list(base)
            for _ in range(rng.randrange(0, max(2, len(cut) // rng.choice([6, 12, 25])))):
                cut[rng.randrange(len(cut))] = rng.choice(letters)
            norms.append(" ".join("".join(cut).split()))
    for gate in (200, 400):
        assert S.greedy_positions(norms, gate) == plain_greedy(norms, gate)


def test_unrelated_texts_are_told_apart_by_bins(monkeypatch):
    """No text's grams are matched in full with those of a text that has little in common with it."""
    rng = random.Random(9)
    norms = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(150)) for _ in range(20)]
    monkeypatch.setattr(S, "_common_fives", None)
    monkeypatch.setattr(S.np, "intersect1d", None)
    assert S.greedy_positions(norms, 200) == list(range(20))
