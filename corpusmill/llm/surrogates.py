"""Personal data replaced by keyed surrogates that keep type, gender, script and format.

Detected mentions are mapped to entities: a kind and a canonical form (digits of a phone number, lower-cased
mail address, one name word). An entity has one surrogate in the whole corpus, so mentions of
one entity stay mentions of one entity, however they are written, and a family name stays shared between the full
name and the form of address. Surrogates come from a keyed permutation of all strings of the same shape
(letters to letters of the script, digits to digits, check digits computed anew), so different
numbers and addresses cannot meet; name words are drawn by a keyed hash from syllables of
their script, given names with an ending of their gender.

Proposals are then checked against each other, against surrogates settled before and against all
real entities; of those that collide one at most is settled and the others are proposed again. This runs on
tables of distinct entities. Texts without personal data never move; of the others, mentions meet the surrogates by
entity and the text by row.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, table
from corpusmill.session import ship_package

#: Only a default: who knows the key can tell which surrogate stands for a guessed original.
KEY = "corpusmill-surrogates"
ROUNDS = 8
#: Proposals before giving up; a proposal collides with a probability far below one half.
ATTEMPTS = 40

# Forms of address with their gender, and common given names with theirs.
MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "госпожа", "г-жа")
OPEN_TITLES = ("Dr", "Prof")
MALE_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Hans", "Jürgen", "Klaus", "Stefan", "Pierre", "Jean", "Michel", "José", "Carlos", "Иван", "Сергей")
FEMALE_NAMES = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Ursula", "Monika", "Petra", "Sabine", "Marie", "Nathalie", "Isabelle", "María", "Carmen", "Анна", "Ольга")

_CAPITAL = r"\p{Lu}[\p{L}\p{M}'’-]+"
_NAME = rf"{_CAPITAL}(?:\ {_CAPITAL}){{0,2}}"
EMAIL = re.compile(
    r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])"
)
NUMBERS = re.compile(
    r"""
    (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))
  | (?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
  | (?P<phone>(?<![\w+])\+[1-9][0-9]{0,2}(?:[\ .-]?\([0-9]{1,4}\))?(?:[\ .-]?[0-9]{2,4}){2,5}(?![\w])
        |(?<!\w)\([0-9]{3}\)\ ?[0-9]{3}[-.\ ][0-9]{4}(?!\w)
        |(?<![\w-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![\w-]))
  | (?P<card>(?<![\w-])[0-9](?:[\ -]?[0-9]){12,18}(?![\w-]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    """,
    re.VERBOSE,
)
NAMES = regex.compile(
    rf"""
    (?:(?<!\w)(?P<title>{"|".join(map(regex.escape, MALE_TITLES + FEMALE_TITLES + OPEN_TITLES))})\.?\ (?P<titled>{_NAME}))
  | (?:(?<!\w)(?P<given>{"|".join(map(regex.escape, MALE_NAMES + FEMALE_NAMES))})\ (?P<family>{_CAPITAL}))
    """,
    regex.VERBOSE,
)
_DIGIT = re.compile(r"[0-9]")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)")
#: Where a rejected number is left off or taken up again: in front of its separators and behind them.
_CUT = re.compile(r"[ .()+-]+")
# Length of an IBAN by country, and of a payment card by its first digits.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: Calling codes of two digits; 1 and 7 have one, all others three, and no code begins another.
CALLING_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CARD_LENGTHS = re.compile(r"4(?:.{12}|.{15}|.{18})|(?:5[1-5]|2[2-7]).{14}|3[47].{13}|3[0689].{12}|(?:6|5[0678]|35).*")
#: Where a name can begin, as plain strings: far cheaper to look for than the pattern.
_CUES = tuple(f"{t}{end}" for t in MALE_TITLES + FEMALE_TITLES + OPEN_TITLES for end in (" ", ". ")) + tuple(
    f"{n} " for n in MALE_NAMES + FEMALE_NAMES
)


def luhn(digits: str) -> int:
    """Check digit that belongs behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of personal data, in order and without overlaps."""
    text, found = text or "", []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += _number_mentions(text)
    if any(cue in text for cue in _CUES):
        for m in NAMES.finditer(text):
            found += _name_words(m)
    out, at = [], 0
    for mention in sorted(found):
        if mention[0] >= at:
            out.append(mention)
            at = mention[1]
    return out


def _number_mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Numbers that pass the checks of their kind. What fails is tried with earlier ends, then from its next group on.

    A card that is only part of a failed run is written in groups of four digits or more, as any table of small numbers
    holds some run that passes the check digit.
    """
    at = failed = 0
    while m := NUMBERS.search(text, at):
        mention = _number_mention(text, m.start(), m.end(), m.lastgroup, m.start() < failed)
        if not mention and m.start() >= failed:
            failed = m.end()
        if mention:
            yield mention
            at = mention[1]
        else:
            cut = _CUT.search(text, m.start() + 1, m.end())
            at = cut.end() if cut else m.end()


def _ends(text: str, start: int, end: int) -> list[int]:
    """``end`` and the ends of the groups before it, longest first."""
    return [end, *reversed([c.start() for c in _CUT.finditer(text, start + 1, end) if c.end() < end])]


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1])


def calling_code(form: str) -> str:
    """The country code of a canonical phone form: '+' and all digits; without '+' there is none."""
    if form[0] != "+":
        return ""
    return form[1 : 2 if form[1] in "17" else 3 if form[1:3] in CALLING_CODES else 4]


def _issued(text: str) -> bool:
    return bool(CARD_LENGTHS.fullmatch(_digits(text)))


def _card_from(text: str, start: int) -> list[int]:
    """Ends of the cards written from ``start`` in groups of four digits or more, of which the last may be shorter."""
    m, out = NUMBERS.match(text, start), []
    if m and m.lastgroup == "card":
        for end in _ends(text, start, m.end()):
            if all(len(g) >= 4 for g in _CUT.split(text[start:end])[:-1]) and _is_card(_digits(text[start:end])):
                out.append(end)
    return out


def _number_mention(text: str, start: int, end: int, kind: str, part: bool = False) -> tuple[int, int, str, str] | None:
    s = text[start:end]
    digits = _digits(s)
    if kind == "iban":
        ends, length = _ends(text, start, end), IBAN_LENGTHS.get(s[:2])
        flat = {e: text[start:e].replace(" ", "") for e in ends}
        # The length of the country comes first, then the longest.
        for e in sorted(ends, key=lambda e: len(flat[e]) != length):
            if 15 <= len(flat[e]) <= 34 and iban_check(flat[e][:2], flat[e][4:]) == flat[e][2:4]:
                return start, e, kind, flat[e]
    elif kind == "ip":
        if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in s.split(".")):
            return start, end, kind, s
    elif kind == "phone":
        # A card of a known issuer that begins inside and goes on behind is not part of the number.
        inside = [c.start() for c in _CUT.finditer(text, start + 1, end) if any(e > end and _issued(text[c.end() : e]) for e in _card_from(text, c.end()))]
        for e in _ends(text, start, min(inside, default=end)):
            digits = _digits(text[start:e])
            if 8 <= len(digits) <= 15:
                plus = "+" if s[0] == "+" else ""
                # A trunk zero is written in one country and left out from abroad: it is not part of the number.
                return start, e, kind, plus + _digits(text[start:e].replace("(0)", "") if plus else text[start:e])
    elif kind == "ssn" or (_is_card(digits) and not part):
        return start, end, kind, digits
    else:
        if _SSN.match(s):
            return start, start + 11, "ssn", digits[:9]
        # Parts of the run: of cards that overlap one of a known issuer's length is taken, then the longest.
        ends = _card_from(text, start)
        parts = [(start, e) for e in ends]
        for c in _CUT.finditer(text, start + 1, max(ends, default=start + 1)):
            parts += [(c.end(), e) for e in _card_from(text, c.end())]
        if parts:
            first, last = max(parts, key=lambda p: (_issued(text[p[0] : p[1]]), p[1] - p[0], -p[0]))
            return first, last, kind, _digits(text[first:last])
    return None


def _name_words(m: regex.Match) -> Iterator[tuple[int, int, str, str]]:
    if m["title"]:
        gender = "m" if m["title"] in MALE_TITLES else "f" if m["title"] in FEMALE_TITLES else "x"
        words = [(w.start() + m.start("titled"), w[0]) for w in regex.finditer(r"[^ ]+", m["titled"])]
        if gender == "x":  # an open title: the first given name of the lists tells
            told = [n for _, n in words[:-1] if n in MALE_NAMES or n in FEMALE_NAMES]
            gender = "x" if not told else "m" if told[0] in MALE_NAMES else "f"
    else:
        gender = "m" if m["given"] in MALE_NAMES else "f"
        words = [(m.start("given"), m["given"]), (m.start("family"), m["family"])]
    for i, (at, word) in enumerate(words):
        kind = "family" if i == len(words) - 1 else f"given-{gender}"
        end = at + len(word)
        if word.endswith(("'s", "’s")):
            word, end = word[:-2], end - 2
        yield at, end, kind, word.lower()


# ---- proposals -------------------------------------------------------------------------------------------------


def _number(key: str, *parts: object) -> int:
    data = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(data, key=hashlib.sha256(key.encode()).digest(), digest_size=32).digest(), "big")


# Alphabets.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def permuted(text: str, key: str, *tweak: object) -> str:
    """Keyed permutation of the strings of one shape: each letter and digit changes within its alphabet, the rest stays.

    A Feistel network over two halves with addition modulo the number of strings of a half.
    """
    spots = [(i, a) for i, c in enumerate(text) for a in LETTERS if c in a]
    if not spots:
        return text
    shape = "".join("aA0"[LETTERS.index(next(a for a in LETTERS if c in a))] if any(c in a for a in LETTERS) else c for c in text)
    halves = [spots[: (len(spots) + 1) // 2], spots[(len(spots) + 1) // 2 :]]
    sizes = [math.prod(len(a) for _, a in h) for h in halves]
    values = []
    for half in halves:
        v = 0
        for i, a in half:
            v = v * len(a) + a.index(text[i])
        values.append(v)
    for r in range(ROUNDS):
        side = r % 2
        values[side] = (values[side] + _number(key, shape, *tweak, r, values[1 - side])) % sizes[side]
    out = list(text)
    for half, v in zip(halves, values):
        for i, a in reversed(half):
            v, d = divmod(v, len(a))
            out[i] = a[d]
    return "".join(out)


def _walk(text: str, fit, key: str, *tweak: object) -> str:
    """The permutation within the strings that ``fit``: repeated until it is one of them again."""
    for _ in range(100_000):
        text = permuted(text, key, *tweak)
        if fit(text):
            return text
    raise RuntimeError("no fitting string found")


# Syllables by script, and endings by script and gender.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo").split(),
    "cyrillic": ("ба бе би бо ва ве ви во га го да де ди до ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то").split(),
}
ENDINGS = {
    ("latin", "m"): ("n", "s", "rd", "k", "l"), ("latin", "f"): ("na", "ra", "la", "nne", "ssa"), ("latin", "x"): ("n", "l", "y"),
    ("cyrillic", "m"): ("н", "р", "л", "к"), ("cyrillic", "f"): ("на", "ра", "ла", "ся"), ("cyrillic", "x"): ("н", "л"),
    ("latin", "family"): ("ller", "rton", "mann", "nez", "rd", "sson"), ("cyrillic", "family"): ("нов", "рин", "ский", "ленко"),
}


def propose(kind: str, form: str, attempt: int, key: str = KEY) -> str:
    """The ``attempt``-th surrogate of an entity, in canonical form."""
    if kind == "email":
        local, domain = form.split("@")
        labels, _, top = domain.rpartition(".")
        # The domain by itself, so that addresses of one house stay together.
        return f"{permuted(local, key, kind, attempt)}@{permuted(labels, key, 'domain')}.{top}"
    if kind == "phone":
        head = form[: form.startswith("+") + len(calling_code(form))]
        rest = form[len(head) :]
        lead = rest[0] in "01"
        return head + _walk(rest, lambda x: (x[0] in "01") == lead, key, kind, attempt)
    if kind == "card":
        middle = permuted(form[1:-1], key, kind, form[0], attempt)
        return form[0] + middle + str(luhn(form[0] + middle))
    if kind == "iban":
        account = permuted(form[4:], key, kind, form[:2], attempt)
        return form[:2] + iban_check(form[:2], account) + account
    if kind == "ip":
        a = ipaddress.IPv4Address(form)
        # Private to private, public to public; every address is eight hexadecimal digits.
        shape = lambda x: (x.is_private, x.is_multicast or x.is_reserved or x.is_unspecified)
        value, half = int(a), [int(a) >> 16, int(a) & 0xFFFF]
        for _ in range(100_000):
            for r in range(ROUNDS):
                half[r % 2] = (half[r % 2] + _number(key, kind, attempt, r, half[1 - r % 2])) % 65536
            value = half[0] << 16 | half[1]
            if shape(ipaddress.IPv4Address(value)) == shape(a):
                return str(ipaddress.IPv4Address(value))
        raise RuntimeError("no fitting address found")
    if kind == "ssn":
        fit = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        return _walk(form, fit, key, kind, attempt) if fit(form) else permuted(form, key, kind, "odd", attempt)
    script = "cyrillic" if regex.search(r"\p{Cyrillic}", form) else "latin"
    seed = _number(key, kind, form, attempt)
    sounds = SYLLABLES[script]
    out = []
    for _ in range(2 + attempt // 4):  # longer names once many are taken
        seed, d = divmod(seed, len(sounds))
        out.append(sounds[d])
    endings = ENDINGS[script, kind.rpartition("-")[2]]
    return "".join(out) + endings[seed % len(endings)]


def dressed(original: str, kind: str, surrogate: str) -> str:
    """The surrogate written the way the original is: separators, groups, and capitals."""
    if kind in ("phone", "card", "iban", "ssn"):
        fresh = iter(surrogate.removeprefix("+"))
        if kind == "phone" and original[0] == "+" and "(0)" in original:
            return "(0)".join("".join(next(fresh) if c.isalnum() else c for c in part) for part in original.split("(0)"))
        return "".join(next(fresh) if c.isalnum() else c for c in original)
    if kind == "email":
        if original.isupper():
            return surrogate.upper()
        return "".join(s.upper() if o.isupper() else s for o, s in itertools.zip_longest(original, surrogate, fillvalue="")) if len(original) == len(surrogate) else surrogate
    if kind == "ip":
        return surrogate
    return surrogate.upper() if len(original) > 1 and original.isupper() else surrogate.capitalize()


# ---- the operator ----------------------------------------------------------------------------------------------


def _space() -> Column:
    """Given names of all genders share one space, so that no surrogate stands for two people's names."""
    return F.when(F.col("kind").startswith("given"), F.lit("given")).otherwise(F.col("kind"))


def resolved(mentions: DataFrame) -> DataFrame:
    """Distinct entities ``space``, ``kind``, ``form`` of mentions (``kind``, ``form``).

    A given name is one entity whatever stood before it. Its gender is the one of most mentions that tell one;
    without any, or with as many of both, it is open.
    """
    told = lambda g: F.count(F.when(F.col("kind") == f"given-{g}", 1))
    counted = mentions.groupBy(_space().alias("space"), "form").agg(told("m").alias("m"), told("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "given-m").when(F.col("m") < F.col("f"), "given-f").otherwise("given-x")
    return counted.select("space", F.when(F.col("space") == "given", gender).otherwise(F.col("space")).alias("kind"), "form")


def settle(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind``, ``form`` and ``surrogate`` for distinct entities (``kind``, ``form``): distinct and never a real entity."""
    ship_package(entities.sparkSession)

    def proposals(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [propose(k, f, attempt, key) for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "form", "surrogate"])

        return run

    space = _space()
    real = entities.select(space.alias("space"), F.col("form").alias("surrogate"))
    pending, settled = entities, None
    for attempt in range(ATTEMPTS):
        made = pending.mapInArrow(proposals(attempt), "kind string, form string, surrogate string").withColumn("space", space)
        free = made.join(real, ["space", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        # Of equal proposals the first entity gets it.
        new = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "form")).alias("e")).select(
            "e.kind", "e.form", "surrogate", "space"
        )
        settled = stored(new if settled is None else settled.unionByName(new))
        pending = stored(entities.join(settled.select("kind", "form"), ["kind", "form"], "left_anti"))
        if pending.isEmpty():
            return settled.drop("space")
    raise RuntimeError(f"entities without a surrogate after {ATTEMPTS} attempts")


def replace_personal(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_mentions and spans (kind:start:end of the original).

    A null text stays null and an empty one empty. Rows that repeat an id are texts of their own, as
    are rows with a null id; every row comes back once. Texts without personal data come back as they
    are. Other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([not mentions(t.as_py()) for t in batch.column(1)], pa.bool_())
            yield batch.filter(keep)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("form", pa.string())]
        kind = pa.list_(pa.struct(fields))
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                if m := mentions(text.as_py()):
                    out.append((uuid.uuid4().hex, doc.as_py(), text.as_py(), [dict(zip(("s", "e", "kind", "form"), x)) for x in m]))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.string(), pa.int64(), pa.string(), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "doc_id", "text", "found"])

    # Written once: the row numbers drawn here must not be drawn again.
    private = stored(rows.mapInArrow(found, "row string, doc_id long, text string, found array<struct<s:int,e:int,kind:string,form:string>>"))
    each = private.select("row", F.explode("found").alias("m")).select("row", "m.s", "m.e", "m.kind", "m.form")
    entities = stored(resolved(each))
    names = settle(entities.select("kind", "form"), key).join(entities, ["kind", "form"]).select("space", "kind", "form", "surrogate")
    each = each.withColumn("space", _space()).drop("kind")
    swaps = each.join(names, ["space", "form"]).groupBy("row").agg(
        F.collect_list(F.struct("s", "e", "kind", "surrogate")).alias("swaps")
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, swaps in zip(*(c.to_pylist() for c in batch.columns)):
                parts, spans, at = [], [], 0
                for w in sorted(swaps, key=lambda w: w["s"]):
                    parts += [text[at : w["s"]], dressed(text[w["s"] : w["e"]], w["kind"], w["surrogate"])]
                    spans.append(f"{w['kind']}:{w['s']}:{w['e']}")
                    at = w["e"]
                out.append((doc, "".join(parts) + text[at:], len(spans), ",".join(spans)))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "text", "n_mentions", "spans"])

    changed = private.join(swaps, "row").select("doc_id", "text", "swaps").mapInArrow(
        rewrite, "doc_id long, text string, n_mentions long, spans string"
    )
    same = rows.mapInArrow(clean, "doc_id long, text string").select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_mentions"), F.lit("").alias("spans")
    )
    return same.unionByName(changed)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal(table(spark, sf_dir, "documents"))
