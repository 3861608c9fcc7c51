"""Exact duplicates, sharding and secret scans on odd rows; none of them may run Python on the executors."""

import collections
import hashlib
import random
import re

import pytest

from corpusmill.llm import exactdedup, queries, secrets, sharding
from tests.conftest import DATA

SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_no_python_in_the_plans(spark):
    for name in ("op3_shard_table", "op8_exact_dedup", "op9_secret_scan"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), plan


# ---- exact duplicates


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i, t))
    out = []
    for i, t in rows:
        n = SPACE.sub("", t or "")
        best = min(groups[n], key=lambda x: x[:3])
        kept = i == best[3] and -len(t or "") == best[0]
        out.append((i, best[3], len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return out


KEY = lambda r: tuple((x is None, x) for x in r)


def test_exact_groups(spark):
    rng = random.Random(1)
    base = ["", " ", "a", "é x", "x" * 100_000, "one two", "日本 語"]
    rows = [(None, "a"), (None, None), (3, None), (3, None), (4, "on e\ttwo"), (4, "one  two")]
    for i in range(300):
        t = rng.choice(base) if i % 3 else f"text {i // 6}"
        rows.append((10 + i, "".join(c + (" " if rng.random() < 0.1 and len(t) < 50 else "") for c in t)))
    rows += [(1000 + i, "hot text") for i in range(400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, group_size int").repartition(5)
    got = [tuple(r)[:5] for r in exactdedup.exact_groups(df, salts=4).collect()]
    assert sorted(got, key=KEY) == sorted(plain_groups(rows), key=KEY)
    assert exactdedup.exact_groups(df.limit(0)).count() == 0
    stay = exactdedup.deduplicated(df)
    assert stay.columns == df.columns
    kept = sorted({(i, t) for (i, t), g in zip(rows, plain_groups(rows)) if g[3]}, key=KEY)
    # Of repeated rows one stays, so every text is there once.
    texts = [SPACE.sub("", r.text or "") for r in stay.collect()]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", t or "") for _, t in kept})


# ---- sharding


def test_table_is_the_plain_one_and_moves_little():
    for shards, slots in ((["a"], 3), (["a", "b", "c"], 13), ([f"s{i}" for i in range(7)], 211)):
        owner = sharding.fill_table(shards, slots)
        start = [sharding._number(f"offset:{s}") % slots for s in shards]
        step = [sharding._number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
        want, turn = {}, 0
        while len(want) < slots:
            i = turn % len(shards)
            slot = next(x for j in range(slots) if (x := (start[i] + j * step[i]) % slots) not in want)
            want[slot] = i
            turn += 1
        assert owner == [want[s] for s in range(slots)]
        counts = collections.Counter(owner).values()
        assert max(counts) - min(counts) <= 1
    before = sharding.fill_table(sharding.SHARDS)
    after = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.15 * sharding.SLOTS


@pytest.mark.parametrize("shards,slots", [([], 13), (["a", "a"], 13), (["a"], 12), (["a"] * 1, 2_000_003)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, slots)


def test_sharded_rows(spark):
    rows = [(None, "x", "mine"), (1, None, "mine"), (1, None, "mine"), (2, "", "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_rows(df).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"doc_id", "text", "slot", "shard"}
    owner = sharding.fill_table(sharding.SHARDS)
    for r in got:
        slot = sharding._number("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[owner[slot]])
    assert sharding.shard_rows(df.limit(0)).count() == 0


# ---- secrets


def plain_spans(text):
    out = []
    for i, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_queries_of_rules():
    assert set(secrets.trigram_query("abc(de|f?g)")) == {
        frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bcf", "cfg"}), frozenset({"abc", "bcg"})
    }
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("(abc|x)") is None
    assert secrets.trigram_query("A[BC]D+") == [frozenset({"abd"}), frozenset({"acd"})]
    every = [secrets.trigram_query(r.pattern) for r in secrets.RULES]
    assert sum(q is None for q in every) == 1


def test_spans_of_odd_rows(spark):
    rng = random.Random(2)
    bits = [
        "password=token:abcdef", "token = 'abc'", "API_KEY: \"s3cr3t/+x\"", "secret:short secret=longer1", "passwd=\"ab\"", "apikey=aaaaaa",
        "AKIA" + "B" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "Z" * 20, "deadbeef" * 3, "deadbeef" * 2, "ghp_" + "a1" * 18, "xoxb-" + "1-a" * 9,
        "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIi.sig-_", "AIza" + "x" * 35, "é日🙂", "PassWord  :  ", "token==", "ſecret=abcdefg", "toKen=abcdefg",
    ]
    texts = [None, "", " "] + bits + [rng.choice([" ", "", ","]).join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts.append("token=abcdef " * 20_000)
    rows = [(t, i, "c") for i, t in enumerate(texts)] + [("password=hidden99", None, "c"), ("nothing", 5, "c"), ("token=abcdefgh", 5, "c"), ("x", None, "c")]
    df = spark.createDataFrame(rows, "text string, doc_id long, rules string").repartition(4)
    got = secrets.secret_spans(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.secret_spans] == plain_spans(r.text), r.text
    clean = {(r.doc_id, r.rules): r.text for r in secrets.redacted(secrets.secret_spans(df.where("doc_id <> 5"))).collect()}
    for t, i, c in rows:
        if i is None or i == 5:
            continue
        covered, want = set(), []
        for s, _, e in plain_spans(t):
            covered |= set(range(s, e))
        last, marks = -1, []
        for s, _, e in plain_spans(t):
            if s >= last:
                marks.append(s)
            last = max(last, e)
        if t is not None and len(t) < 5000:
            for j, ch in enumerate(t):
                if j in marks:
                    want.append("[SECRET]")
                if j not in covered:
                    want.append(ch)
            assert clean[i, c] == "".join(want)
    assert clean[0, "c"] is None
    assert secrets.secret_spans(df.limit(0)).count() == 0
