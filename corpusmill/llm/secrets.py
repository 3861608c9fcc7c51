"""Secret scans through a trigram inverted index; DataFrame functions only.

Each rule's regular expression yields a Boolean query: the trigrams that every match must contain,
as alternatives of conjunctions. The corpus is indexed for the trigrams which the rules ask for: one
posting (trigram, document) per occurrence of a trigram in a document, on lower-cased text. The
postings of a document are intersected into bit sets and every rule's query is evaluated on them;
only the rules that pass are verified against the document's text with the regular expression. A
rule without mandatory trigrams (a run of hexadecimal digits) is verified on every document.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import carried, table, text_of, with_running

# Python's parser of regular expressions; only its parse tree is used.
from re import _constants as K  # noqa: I001
from re import _parser as parser


@dataclass(frozen=True)
class Rule:
    """``kind``; ``pattern`` (Java syntax within what Python parses too); a match counts if ``group`` has ``least`` code points.

    ``base`` marks the rules of the contract, the others add spans.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules of the contract, then public formats of access tokens and keys.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # These runs are maximal, so the least length can stand in the pattern: no shorter match hides a longer one.
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: Alternatives per rule. With more, a part of the pattern is taken as unknown, which only weakens the query.
MAX_ALTERNATIVES = 64
_WORD = 60  # trigram bits in one long


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The rule's query as alternatives of trigram sets (lower case), or None if some match needs no trigram."""

    def walk(items, ways: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """``ways``: for each alternative the literal runs so far; the last one is still open."""

        def broken(ws):
            return [(*w, "") for w in ws]

        def each(ws, options):
            out = list(dict.fromkeys(o for option in options for o in option(ws)))
            return out if len(out) <= MAX_ALTERNATIVES else list(dict.fromkeys(broken(ws)))

        for op, arg in items:
            if op is K.LITERAL:
                ways = [(*w[:-1], w[-1] + chr(arg).lower()) for w in ways]
            elif op is K.IN and len(arg) <= 8 and all(o is K.LITERAL for o, _ in arg):
                ways = each(ways, [lambda ws, c=c: [(*w[:-1], w[-1] + chr(c).lower()) for w in ws] for _, c in arg])
            elif op is K.SUBPATTERN:
                ways = walk(arg[3], ways)
            elif op is K.BRANCH:
                ways = each(ways, [lambda ws, b=b: walk(b, ws) for b in arg[1]])
            elif op is K.MAX_REPEAT and arg[:2] == (0, 1):
                ways = each(ways, [lambda ws: ws, lambda ws, x=arg[2]: walk(x, ws)])
            elif op is K.MAX_REPEAT and arg[0] >= 1:
                ways = broken(walk(arg[2], ways))
            else:
                ways = broken(ways)
        return ways

    found = [
        frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2))
        for way in walk(parser.parse(pattern), [("",)])
    ]
    if not all(found):
        return None
    return [s for s in dict.fromkeys(found) if not any(o < s for o in found)]


def trigram_index(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (``trigram``, ``doc``) of the given trigrams: the corpus's inverted index, cut to what is asked for."""
    folded = docs.select(F.col(id_col).alias("doc"), F.lower(text_of(text_col)).alias("_low"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams)]))
    return folded.select("doc", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, trigrams: Sequence[str], asked: dict[int, list[frozenset[str]]]) -> DataFrame:
    """Documents whose postings satisfy a rule's query: ``doc`` and ``rules`` (positions of the rules)."""
    place = {g: i for i, g in enumerate(trigrams)}
    words = range((len(trigrams) + _WORD - 1) // _WORD)
    held = index.groupBy("doc").agg(*[
        F.coalesce(
            F.bit_or(F.when(F.floor(F.col("trigram") / _WORD) == w, F.expr(f"shiftleft(1L, trigram % {_WORD})"))), F.lit(0)
        ).cast("long").alias(f"w{w}")
        for w in words
    ])

    def has(grams: frozenset[str]) -> Column:
        masks = {w: sum(1 << place[g] % _WORD for g in grams if place[g] // _WORD == w) for w in words}
        return reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items() if m])

    passed = [F.when(reduce(lambda a, b: a | b, map(has, ways)), F.lit(r)) for r, ways in asked.items()]
    return held.select("doc", F.array_compact(F.array(*passed)).alias("rules")).where(F.size("rules") > 0)


def _matched(df: DataFrame, rule: Rule, number: int, due: Column) -> DataFrame:
    """Add ``_found<number>``: spans of all leftmost non-overlapping matches in ``_text`` that are long enough, in code points.

    The pieces between the matches and the matches alternate, so their lengths add up to positions.
    """
    pattern, text, none = F.lit(rule.pattern), F.col("_text"), F.array().cast("array<int>")

    def lengths(pieces: Column) -> Column:
        return F.when(due, F.transform(pieces, lambda p: F.length(p))).otherwise(none)

    df = df.withColumn("_between", lengths(F.split(text, rule.pattern, -1))).withColumn(
        "_whole", lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    )
    judged = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else F.col("_whole")
    df = df.withColumn("_judged", judged).withColumn(
        "_steps", F.zip_with("_between", "_whole", lambda p, m: F.coalesce(p, F.lit(0)) + F.coalesce(m, F.lit(0)))
    )
    df = with_running(df, "_steps", "_heads", lambda a, b: a + b, F.lit(0))
    spans = F.zip_with(
        F.zip_with("_heads", "_between", lambda h, p: h + p),
        F.zip_with("_whole", "_judged", lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        lambda s, x: F.struct(
            s.alias("start"), F.lit(number).alias("rule"), (s + x["m"]).alias("end"), (x["g"] >= rule.least).alias("good")
        ),
    )
    good = F.filter(spans, lambda s: F.coalesce(s["good"], F.lit(False)))
    found = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["rule"].alias("rule"), s["end"].alias("end")))
    return df.withColumn(f"_found{number}", found.cast(SPAN)).drop("_between", "_whole", "_judged", "_steps", "_heads")


SPAN = "array<struct<start:int,rule:int,end:int>>"


def secret_spans(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All input columns and ``secret_spans``: (start, rule, end) by start and rule, in code points, end exclusive.

    A null or empty text has no spans. Rows that repeat an id are each scanned for themselves; the
    index may hand them rules of their namesakes, which verification then settles. Rows with a null
    id share one entry of the index in the same way. A column ``secret_spans`` of the input is replaced.
    """
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    asked = {i: q for i, q in queries.items() if q is not None}
    trigrams = sorted(set(itertools.chain.from_iterable(s for q in asked.values() for s in q)))

    def step(rows: DataFrame) -> DataFrame:
        passed = candidates(trigram_index(rows, trigrams, "doc_id", "text"), trigrams, asked)
        passed = passed.select(F.col("doc").alias("_doc"), F.col("rules").alias("_rules"))
        joined = rows.join(passed, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("_text", text_of("text"))
        for i, rule in enumerate(rules):
            if i in asked:
                due = F.coalesce(F.array_contains("_rules", i), F.lit(False))
            else:
                due = F.col("_text").rlike(rule.pattern)
            joined = _matched(joined, rule, i, due)
        found = [F.col(f"_found{i}") for i in range(len(rules))]
        return joined.select("doc_id", "text", "_rest", F.sort_array(F.concat(*found)).alias("secret_spans"))

    return carried(docs, step, {"doc_id": id_col, "text": text_col}, ["secret_spans"])


def redacted(found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every stretch covered by ``secret_spans`` by ``mark``; a null text stays null. The spans are dropped."""
    def step(rows: DataFrame) -> DataFrame:
        text, spans = F.col("text"), F.col("spans")
        marked = rows.withColumn("_ends", F.transform(spans, lambda s: s["end"]))
        marked = with_running(marked, "_ends", "_before", lambda a, b: F.greatest(a, b), F.lit(0))
        # From the end of all earlier spans to the start of this one; nothing (not even a mark) where they overlap.
        parts = F.zip_with(
            spans, "_before",
            lambda s, e: F.when(s["start"] >= e, F.concat(F.substr(text, e + 1, s["start"] - e), F.lit(mark))).otherwise(F.lit("")),
        )
        tail = F.substr(text, F.array_max("_ends") + 1)
        clean = F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), tail))
        return marked.withColumn("text", clean).drop("spans")

    return carried(found, step, {"text": text_col, "spans": "secret_spans"})


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    names = F.array(*[F.lit(r.kind) for r in RULES])
    base = [i for i, r in enumerate(RULES) if r.base]

    def digest(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str) -> Column:
        number = next(i for i, r in enumerate(RULES) if r.kind == kind)
        return F.size(F.filter("secret_spans", lambda s: s["rule"] == number)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(digest(F.filter("secret_spans", lambda s: s["rule"].isin(base))), 256).alias("base_sha256"),
        digest(F.col("secret_spans")).alias("spans"),
    )


def _op9_sql() -> str:
    def spans(i: int, rule: Rule) -> str:
        quoted = "'" + rule.pattern.replace("'", "''") + "'"
        return f"""
      (SELECT list({{'s': b, 'r': {i}, 'e': b + length(m[k])}}) FROM (
         SELECT k, m, g, list_sum([length(x) FOR x IN p[1:k]]) + coalesce(list_sum([length(x) FOR x IN m[1:k - 1]]), 0) AS b
         FROM (SELECT regexp_extract_all(t, {quoted}) AS m, regexp_extract_all(t, {quoted}, {rule.group}) AS g,
                      string_split_regex(t, {quoted}) AS p), unnest(range(1, len(m) + 1)) AS u(k)
       ) WHERE length(g[k]) >= {rule.least})"""

    each = " || ".join(f"coalesce({spans(i, r)}, [])" for i, r in enumerate(RULES))
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    base = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
    text = f"{names}[x.r + 1] || ':' || x.s || ':' || x.e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort({each}) AS found FROM d)
SELECT doc_id, len([1 FOR x IN found IF x.r = 0]) AS n_assign, len([1 FOR x IN found IF x.r = 1]) AS n_access,
       len([1 FOR x IN found IF x.r = 2]) AS n_hex,
       sha256(array_to_string([{text} FOR x IN found IF x.r IN ({base})], ',')) AS base_sha256,
       array_to_string([{text} FOR x IN found], ',') AS spans
FROM f"""


OP9_SQL = _op9_sql()
