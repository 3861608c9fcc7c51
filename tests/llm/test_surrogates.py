import itertools
import random

import pytest

from corpusmill.llm import surrogates as P
from tests.conftest import DATA


def test_permutation_is_one_and_keeps_the_shape():
    texts = ["".join(t) for t in itertools.product("0123456789", repeat=3)]
    assert sorted(P.permuted(t, "k", 1) for t in texts) == texts
    assert P.permuted("aB-3 é", "k")[2] == "-" and P.permuted("aB-3 é", "k")[-2:] == " é"
    assert P.permuted("abc123", "k") != P.permuted("abc123", "other")
    assert P.permuted("", "k") == "" and P.permuted("..", "k") == ".."


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("mail fakol.33@mail7.example.com now", ["email"]),
        ("call +1 (375) 555-4393, or (212) 555-0188.", ["phone", "phone"]),
        ("from 28.125.121.88 to 999.1.1.1", ["ip"]),
        ("card 4863730426282943 and 4111 1111 1111 1111", ["card"]),
        ("Version 2.0. On 1234567890123456 the", []),
        ("IBAN DE89 3704 0044 0532 0130 00!", ["iban"]),
        ("SSN 123-45-6789", ["ssn"]),
        ("Mrs Smith met Anna", ["family"]),
        ("Frau Ursula Maier's cat, Herr Jürgen Maier", ["given-f", "family", "given-m", "family"]),
        ("Linda Jones und г-жа Анна Иванова", ["given-f", "family", "given-f", "family"]),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, kinds):
    got = [m[2] for m in P.mentions(text)]
    if "card" in kinds:
        valid = [d for d in ("4863730426282943", "4111111111111111") if P.luhn(d[:-1]) == int(d[-1])]
        assert got == ["card"] * len(valid)
    else:
        assert got == kinds


@pytest.mark.parametrize(
    "text,want",
    [
        ("pay 4111 1111 1111 1111 12/27 now", ["4111 1111 1111 1111"]),
        ("pay 4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
        ("pay 4111-1111-1111-1111 123, ok", ["4111-1111-1111-1111"]),
        ("4111111111111111 123", ["4111111111111111"]),
        ("3782 822463 10005 1234", ["3782 822463 10005"]),
        ("12 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("No. 2024 4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
        ("1 23 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("4111 1111 1111 1111 5500 0000 0000 0004 99", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
        ("BE68 5390 0754 7034 EUR", ["BE68 5390 0754 7034"]),
        ("AT61 1904 3002 3457 3201 EURO", ["AT61 1904 3002 3457 3201"]),
        ("ES91 2100 0418 4502 0005 1332 BIC", ["ES91 2100 0418 4502 0005 1332"]),
        ("PL61 1090 1014 0000 0712 1981 2874 X", ["PL61 1090 1014 0000 0712 1981 2874"]),
        ("DE89 3704 0044 0532 0130 00 EUR", ["DE89 3704 0044 0532 0130 00"]),
        ("AB12 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("+44 20 7946 0958 4111 1111 1111 1111", ["+44 20 7946 0958", "4111 1111 1111 1111"]),
        ("+1 212 555 0188 4111 1111 1111 1111", ["+1 212 555 0188", "4111 1111 1111 1111"]),
        ("123-45-6789 1234 5678", ["123-45-6789"]),
        ("table 100 200 300 400 500 600 703 100 200 300 400 500", []),
    ],
)
def test_a_failed_candidate_gives_its_parts_back(text, want):
    assert [text[s:e] for s, e, *_ in P.mentions(text)] == want


def test_surrogates_are_of_the_same_kind():
    for text in ("fakol.33@mail7.example.com", "+1 (375) 555-4393", "28.125.121.88", "10.0.0.7", "4111-1111-1111-1111", "DE89 3704 0044 0532 0130 00", "123-45-6789", "Mrs SMITH", "г-жа Анна Иванова"):
        for attempt in range(3):
            out, at = [], 0
            for s, e, kind, form in P.mentions(text):
                out += [text[at:s], P.dressed(text[s:e], kind, P.propose(kind, form, attempt))]
                at = e
            made = "".join(out) + text[at:]
            assert made != text
            assert [m[2] for m in P.mentions(made)] == [m[2] for m in P.mentions(text)], (text, made)
            if text[0] in "+1245D":
                assert [c if not c.isalnum() else "x" for c in made if c != "."] == [c if not c.isalnum() else "x" for c in text if c != "."] or "." in text


def test_corpus(spark, monkeypatch):
    rng = random.Random(1)
    mails = [f"user{i}@host{i % 5}.example.com" for i in range(40)]
    # Few surrogates for many names: collisions must be found and settled.
    names = ["Mrs " + "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize() for _ in range(300)]
    rows = [(i, f"Text {i} {rng.choice(mails)} and {n} wrote.", 1) for i, n in enumerate(names)]
    rows += [(1000 + i, f"always {mails[0]} of +1 (212) 555-0100 alias +1-212-555-0100", 1) for i in range(100)]
    rows += [(None, "x@y.example.com", 1), (5000, None, 1), (5001, "", 1), (5002, "Nothing here. Version 2.0.", 1), (5002, "Nothing here. Version 2.0.", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_mentions int").repartition(4)
    got = P.replace_personal(df).collect()
    assert len(got) == len(rows)
    before, after = {}, {}
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows[:400]:
        new = by_id[i][0].text
        old_m, new_m = P.mentions(text), P.mentions(new)
        assert [m[2] for m in old_m] == [m[2] for m in new_m] and by_id[i][0].n_mentions == len(old_m)
        for a, b in zip(old_m, new_m):
            assert before.setdefault(a[2:], b[2:]) == b[2:]  # one surrogate for an entity
            assert after.setdefault(b[2:], a[2:]) == a[2:]  # and one entity for a surrogate
    assert not set(before) & set(after)
    assert by_id[5000][0].text is None and by_id[5001][0].text == ""
    assert [r.text for r in by_id[5002]] == ["Nothing here. Version 2.0."] * 2
    assert by_id[None][0].text != "x@y.example.com"
    assert {r.text.replace("-", " ").count(" ") for r in by_id[1000]} and len({r.text for i in range(100) for r in by_id[1000 + i]}) == 1
    assert P.replace_personal(df.limit(0)).count() == 0


def test_collisions_are_settled(spark, monkeypatch):
    sounds = P.SYLLABLES["latin"]
    forms = [(("given-f", "given-m", "family")[i % 3], f"{a}{b}n") for i, (a, b) in enumerate(itertools.product(sounds, sounds))]
    got = P.settle(spark.createDataFrame(forms, "kind string, form string")).collect()
    assert len(got) == len(forms)
    space = lambda k: k.partition("-")[0]
    assert len({(space(r.kind), r.surrogate) for r in got}) == len(forms)
    assert not {(space(r.kind), r.surrogate) for r in got} & {(space(k), f) for k, f in forms}


@pytest.mark.parametrize(
    "code,writings",
    [
        ("49", ["+49 30 1234567", "+49301234567", "+49-30-123-4567", "+49 (0)30 1234567", "+49 (30) 1234567"]),
        ("33", ["+33 14 268 5300", "+33142685300"]),
        ("44", ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958"]),
        ("351", ["+351 21 123 4567", "+351211234567"]),
        ("1", ["+1 (375) 555-4393", "+13755554393", "+1-375-555-4393"]),
        ("7", ["+7 (495) 123-4567", "+74951234567"]),
    ],
)
def test_a_phone_number_is_one_entity_however_written(code, writings):
    made = set()
    for text in writings:
        ((start, end, kind, form),) = P.mentions(text)
        assert (start, end, kind) == (0, len(text), "phone") and P.calling_code(form) == code
        new = P.dressed(text, kind, P.propose(kind, form, 0))
        assert new.startswith("+" + code) and [c for c in new if not c.isdigit()] == [c for c in text if not c.isdigit()]
        assert ("(0)" in new) == ("(0)" in text)
        made.add(P.mentions(new)[0][3])
    assert len(made) == 1 and not made & {P.mentions(t)[0][3] for t in writings}


def test_a_given_name_is_one_entity_of_one_gender(spark):
    rows = [(1, "Dr Mary Smith"), (2, "Mary Smith"), (3, "Mrs Mary Smith"), (4, "Prof. Tove Hall"), (5, "Frau Tove Hall"), (6, "Dr Kim Lee"), (7, "Mr Robin Hood"), (8, "Ms Robin Hood")]
    got = {r.doc_id: r for r in P.replace_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [m[2] for m in P.mentions("Dr Mary Smith")] == ["given-f", "family"]
    given = {i: r.text.split()[-2] for i, r in got.items()}
    assert given[1] == given[2] == given[3] and given[4] == given[5] and given[7] == given[8]
    assert len({given[i] for i in (1, 4, 6, 7)}) == 4
    kinds = {i: r.spans.split(":")[0] for i, r in got.items()}
    assert [kinds[i] for i in range(1, 9)] == ["given-f"] * 5 + ["given-x"] * 3
    assert given[1].endswith(P.ENDINGS["latin", "f"]) and given[4].endswith(P.ENDINGS["latin", "f"])


def test_given_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in P.op2_surrogates(spark, DATA).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        found = P.mentions(text)
        assert got[i].n_mentions == len(found) and (found or got[i].text == text)
        assert not any(text[s:e] in got[i].text for s, e, *_ in found)
