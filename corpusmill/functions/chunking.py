"""Splitting a text into retrieval chunks, as native array expressions.

Order-dependent packing is a fold over the sentence array; headings and numbered clauses are found by
pattern and turned into array positions. Only near-duplicate removal inside a document leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.arrays import let, merge_adjacent, pick, slices, strings
from corpusmill.functions.similarity import kept_positions, kept_positions_nested
from corpusmill.functions.text import CUT, SPACE, lines, normalize_text, split_sentences, strip
from corpusmill.functions.vector import cosine_similarity
from corpusmill.session import deal, ship_package

# --- Fixed values: heading and numbering patterns ------------------------------------------------
HEADING = (
    r"(?iu)^(?:Chương\s+[IVXLCDM\d]+|Phần\s+[IVXLCDM\d]+|Mục\s+\d+|Điều\s+\d+[.:]?|Khoản\s+\d+[.:]?)"
)
INLINE_HEADING = r"(?iu)^(Điều\s+\d+[.:]?\s*)(.+)"
CLAUSE = r"(?md)^\s*\d+\.\s+.*"
SUBCLAUSE = r"(?md)^\s*\d+\.\d+\.?\s+.*"
CLAUSE_LINE = r"^\s*(\d+)\.\s+(.*)"
SUBCLAUSE_LINE = r"^\s*(\d+\.\d+)\.?\s+(.*)"
MAX_HEADING_CHARS = 150
MAX_INLINE_HEADING_CHARS = 30
#: Stored bytes of input that a task chunks: a text becomes arrays of sentences, pieces and their normal forms at once.
LOT_BYTES = 2 * 1024 * 1024


def _unicode(pattern: str) -> str:
    """Let \\s and \\d mean what they mean for Unicode text."""
    return pattern.replace(r"\s", f"[{SPACE}]").replace(r"\d", r"\p{Nd}")


def effective_min(requested: int | None = None, max_chars: int = fixed.MAX_CHARS) -> int:
    wanted = max(fixed.MIN_CHARS if requested is None else requested, fixed.MIN_FLOOR)
    return max(fixed.MIN_FLOOR, max_chars) if wanted > max_chars else wanted


def _join_short(parts: Column, low: int, high: int) -> Column:
    """Merge parts below ``low`` into a neighbour while the result stays within ``high``."""

    def fits(a: Column, b: Column) -> Column:
        short = (F.length(strip(a)) < low) | (F.length(strip(b)) < low)
        return (F.length(a) + F.length(b) + 1 <= high) & short

    def close_tail(a: Column) -> Column:
        last, before = F.element_at(a, -1), F.element_at(a, -2)
        mergeable = (F.length(strip(last)) < low) & (F.length(before) + F.length(last) + 1 <= high)
        joined = F.concat(F.slice(a, 1, F.size(a) - 2), strings(F.concat(before, F.lit(" "), last)))
        return F.when((F.size(a) > 1), F.when(mergeable, joined).otherwise(a)).otherwise(a)

    return F.when(F.size(parts) > 1, let(merge_adjacent(parts, fits), close_tail)).otherwise(parts)


def _select(parts: Column, text: Column, low: int, high: int) -> Column:
    """Parts of sufficient length; failing that those above the floor; failing that the text's start."""
    whole = let(strip(text), lambda t: F.when(
        F.length(t) >= fixed.MIN_FLOOR, strings(F.substring(t, 1, high))
    ).otherwise(strings()))

    def fallback(p: Column) -> Column:
        return let(
            F.filter(p, lambda c: F.length(c) >= fixed.MIN_FLOOR),
            lambda ok: F.when(F.size(ok) > 0, ok).otherwise(whole),
        )

    return let(
        F.filter(parts, lambda c: F.length(c) >= low),
        lambda good: F.when(F.size(good) > 0, good).otherwise(fallback(parts)),
    )


def _split_long(parts: Column, high: int) -> Column:
    """Parts above ``high`` cut between their sentences, which are packed anew; a sentence itself stays whole."""

    def again(part: Column) -> Column:
        return merge_adjacent(split_sentences(part), lambda a, b: F.length(a) + F.length(b) + 1 <= high)

    cut = F.flatten(F.transform(parts, lambda c: F.when(F.length(c) > high, again(c)).otherwise(strings(c))))
    return F.when(F.exists(parts, lambda c: F.length(c) > high), cut).otherwise(parts)


def _packed(sentences: Column, low: int, high: int) -> Column:
    """Sentences packed up to ``high``, short pieces joined, overlong ones cut."""
    packed = merge_adjacent(sentences, lambda a, b: F.length(a) + F.length(b) + 1 <= high)
    return let(_join_short(packed, low, high), lambda p: _split_long(p, high))


def pack_sentences(text: Column, min_chars: int = fixed.MIN_CHARS, max_chars: int = fixed.MAX_CHARS) -> Column:
    """Sentences packed up to ``max_chars``, short pieces joined; near duplicates are still in."""
    low = effective_min(min_chars)

    def several(sentences: Column) -> Column:
        return let(_packed(sentences, low, max_chars), lambda p: _select(p, text, low, max_chars))

    def single(sentence: Column) -> Column:
        cut = strings(F.substring(sentence, 1, max_chars))
        return F.when(F.length(sentence) >= fixed.MIN_FLOOR, cut).otherwise(strings())

    return let(
        split_sentences(text),
        lambda s: F.when(F.size(s) == 0, strings())
        .when(F.size(s) == 1, single(F.element_at(s, 1)))
        .otherwise(several(s)),
    )


def _not_packed(text: Column, min_chars: int, max_chars: int) -> Column:
    """Whether ``pack_sentences`` takes the text itself: it is one sentence, or all its parts are below the floor."""

    def short(sentences: Column) -> Column:
        return ~F.exists(_packed(sentences, effective_min(min_chars), max_chars), lambda c: F.length(c) >= fixed.MIN_FLOOR)

    return let(split_sentences(text), lambda s: (F.size(s) == 1) | short(s))


def pack_by_meaning(
    text: Column,
    vectors: Column,
    min_chars: int = fixed.MIN_CHARS,
    max_chars: int = fixed.MAX_CHARS,
    threshold: float = fixed.BREAK_THRESHOLD,
) -> Column:
    """Break between sentences whose vectors are less similar than ``threshold``, then pack.

    ``vectors`` holds one embedding per sentence of ``text``, from the caller's model. Long texts are
    packed by sentence alone.
    """
    low = effective_min(min_chars)

    def several(sentences: Column) -> Column:
        def mark(s: Column, i: Column) -> Column:
            alike = cosine_similarity(F.get(vectors, i - 1), F.get(vectors, i))
            return F.when(i == 0, s).when(alike < threshold, F.concat(F.lit(CUT), s)).otherwise(
                F.concat(F.lit(" "), s)
            )

        segments = F.split(F.array_join(F.transform(sentences, mark), ""), CUT)
        packed = merge_adjacent(segments, lambda a, b: F.length(a) + F.length(b) + 1 <= max_chars)
        return let(_join_short(packed, low, max_chars), lambda p: _select(p, text, low, max_chars))

    def route(s: Column) -> Column:
        long = (F.length(text) > fixed.SEMANTIC_MAX_CHARS) | (F.size(s) > fixed.SEMANTIC_MAX_SENTENCES)
        return (
            F.when(long, pack_sentences(text, min_chars, max_chars))
            .when(F.size(s) == 0, strings())
            .when(
                F.size(s) == 1,
                F.when(F.length(F.element_at(s, 1)) >= fixed.MIN_FLOOR, s).otherwise(strings()),
            )
            .otherwise(several(s))
        )

    return let(split_sentences(text), route)


def split_sections(text: Column) -> Column:
    """array<struct<heading, body>>: the text cut at chapter, section and article headings.

    A short heading line belongs to the heading only; a long line starting with an article number is
    split after the number. Sections without a body are dropped; no heading means one section.
    """

    def describe(line: Column) -> Column:
        def by_content(s: Column) -> Column:
            is_heading = (F.length(s) < MAX_HEADING_CHARS) & s.rlike(_unicode(HEADING))
            label = F.regexp_extract(s, _unicode(INLINE_HEADING), 1)
            rest = F.regexp_extract(s, _unicode(INLINE_HEADING), 2)
            inline = (label != "") & (F.length(label) < MAX_INLINE_HEADING_CHARS)
            nothing = F.lit(None).cast("string")
            return (
                F.when(is_heading, F.struct(s.alias("heading"), nothing.alias("body")))
                .when(inline, F.struct(strip(label).alias("heading"), rest.alias("body")))
                .otherwise(F.struct(nothing.alias("heading"), line.alias("body")))
            )

        return let(strip(line), by_content)

    def assemble(marked: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.size(marked))
        starts = F.filter(numbers, lambda i: F.element_at(marked, i)["heading"].isNotNull())

        def section(all_starts: Column) -> Callable[[Column, Column], Column]:
            def build(start: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(all_starts, i + 1), F.size(marked) + 1)
                body = F.transform(F.slice(marked, start, stop - start), lambda m: m["body"])
                return F.struct(
                    F.coalesce(F.element_at(marked, start)["heading"], F.lit("")).alias("heading"),
                    strip(F.array_join(body, "\n")).alias("body"),
                )

            return build

        def cut(found: Column) -> Column:
            opened = F.array_distinct(F.concat(F.array(F.lit(1)), found))
            return let(opened, lambda st: F.filter(F.transform(st, section(st)), lambda s: s["body"] != ""))

        return let(starts, lambda st: F.when(F.size(st) > 0, cut(st)))

    whole = F.array(F.struct(F.lit("").alias("heading"), strip(text).alias("body")))
    return let(
        let(F.transform(lines(text), describe), assemble),
        lambda s: F.when(F.size(s) > 0, s).otherwise(whole),
    )


def _heading_path(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts])


def _cut_before(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, _unicode(pattern), CUT + "$0"), CUT)


def _after_first_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^[^\n]*\n?", ""))


def _long_enough(units: Column) -> Column:
    return F.filter(units, lambda u: F.length(u["text"]) >= fixed.MIN_FLOOR)


def _unit(heading: Column, text: Column) -> Column:
    return F.struct(heading.alias("heading"), text.alias("text"))


def _lines_join(first: Column, rest: Column) -> Column:
    return strip(F.concat_ws("\n", F.nullif(first, F.lit("")), F.nullif(rest, F.lit(""))))


def split_numbered(heading: Column, body: Column) -> Column:
    """array<struct<heading, text>> of a section numbered ``1.`` / ``1.1``; null if it is not.

    A clause with subclauses yields the group as a whole and every subclause, which repeats the
    clause line; a clause without subclauses, or a bare list of subclauses, yields its items.
    """

    def subclauses(blocks: Column, lead: Column | None) -> Column:
        def item(block: Column) -> Column:
            def build(b: Column) -> Column:
                first = F.regexp_extract(b, r"^[^\n]*", 0)
                number = F.regexp_extract(first, _unicode(SUBCLAUSE_LINE), 1)
                remainder = F.regexp_extract(first, _unicode(SUBCLAUSE_LINE), 2)
                label = F.when(number != "", F.concat(number, F.lit(".")))
                opening = remainder if lead is None else strip(F.concat(lead, F.lit(" "), remainder))
                path = _heading_path(heading, *([] if lead is None else [lead]), F.coalesce(label, F.lit("")))
                return _unit(path, _lines_join(opening, _after_first_line(b)))

            return let(strip(block), build)

        return F.transform(F.slice(blocks, 2, F.size(blocks)), item)

    def intro(blocks: Column) -> Column:
        return F.array(_unit(heading, strip(F.element_at(blocks, 1))))

    def clause(block: Column) -> Column:
        line = strip(F.regexp_extract(block, _unicode(CLAUSE.replace("^", r"\A")), 0))

        def build(b: Column) -> Column:
            def with_rest(rest: Column) -> Column:
                remainder = F.regexp_extract(F.regexp_extract(b, r"^[^\n]*", 0), _unicode(CLAUSE_LINE), 2)
                flat = F.array(_unit(heading, _lines_join(remainder, rest)))
                group = F.array(_unit(_heading_path(heading, line), rest))
                return let(
                    _cut_before(rest, SUBCLAUSE),
                    lambda subs: F.when(F.size(subs) > 1, F.concat(group, subclauses(subs, line))).otherwise(flat),
                )

            return let(_after_first_line(b), with_rest)

        return let(strip(block), build)

    def by_clause(blocks: Column) -> Column:
        found = F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), clause))
        return F.concat(intro(blocks), found)

    def by_subclause(blocks: Column) -> Column:
        return F.concat(intro(blocks), subclauses(blocks, None))

    def route(blocks: Column) -> Column:
        return F.when(F.size(blocks) > 1, by_clause(blocks)).otherwise(
            let(_cut_before(body, SUBCLAUSE), lambda subs: F.when(F.size(subs) > 1, by_subclause(subs)))
        )

    return let(
        let(let(body, lambda b: _cut_before(b, CLAUSE)), route),
        lambda units: let(_long_enough(units), lambda u: F.when(F.size(u) > 0, u)),
    )


def add_overlap(chunks: Column, sentences: int = fixed.CONTEXT_WINDOW, max_chars: int = fixed.MAX_CHARS) -> Column:
    """Start each chunk with the last sentences of the one before, unless they are there already."""

    def extend(chunk: Column, i: Column) -> Column:
        before = F.get(chunks, i - 1)
        tail = let(
            split_sentences(before),
            lambda s: F.when(F.size(s) >= sentences, F.array_join(F.slice(s, -sentences, sentences), " ")).otherwise(
                F.substring(before, 1, 200)
            ),
        )

        def apply(t: Column) -> Column:
            longer = F.concat(t, F.lit(" "), chunk)
            usable = (t != "") & ~F.contains(F.substring(chunk, 1, 350), t)
            return F.when(
                usable & (F.length(longer) <= max_chars + fixed.OVERLAP_EXTRA), longer
            ).otherwise(chunk)

        return F.when(i == 0, chunk).otherwise(let(tail, apply))

    return F.when(F.size(chunks) > 1, F.transform(chunks, extend)).otherwise(chunks)


def with_heading(chunk: Column, heading: Column, category: Column) -> Column:
    """Prefix category and heading, unless the chunk already starts with the heading."""
    tag = F.when((category != "") & (category != "unknown"), F.concat(F.lit("["), category, F.lit("]")))
    prefix = F.concat(F.concat_ws(" | ", tag, F.nullif(strip(heading), F.lit(""))), F.lit(":\n"))
    start = F.substring(F.lower(strip(heading)), 1, 20)
    repeated = F.startswith(F.lower(strip(chunk)), start)
    return F.when((heading == "") | repeated, chunk).otherwise(F.concat(prefix, chunk))


def _shorten(chunk: Column, headed: Column, max_chars: int, keep_min: int | None) -> Column:
    """Cut an overlong chunk, keeping its heading prefix whole."""
    at = F.instr(chunk, ":\n")
    prefix = F.substring(chunk, F.lit(1), at + 1)
    body = F.substring(chunk, at + 2, F.length(chunk))
    if keep_min is not None:
        body = strip(body)
    room = F.greatest(F.lit(0), F.lit(max_chars) - F.length(prefix))
    kept = strip(F.concat(prefix, F.substring(body, F.lit(1), room)))
    plain = strip(F.substring(chunk, 1, max_chars))
    if keep_min is not None:
        kept = let(
            kept,
            lambda k: F.when((F.length(k) < keep_min) & (F.length(strip(chunk)) >= keep_min), plain).otherwise(k),
        )
    return F.when(F.length(chunk) <= max_chars, chunk).when(headed & (at > 0), kept).otherwise(plain)


def _normalized(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: normalize_text(c))


def dedup_chunks(df: DataFrame, column: str, gate: int = fixed.DEDUP_GATE_CHUNKS, spared: Column | None = None) -> DataFrame:
    """Greedy near-duplicate removal inside one array column; one-element arrays stay in the JVM.

    Chunks without a word go, but for the only chunk of a row that is ``spared``.
    """
    ship_package(df.sparkSession)
    chunks = F.col(column)
    several = F.size(chunks) > 1
    kept = kept_positions(gate)(F.when(several, _normalized(chunks)).otherwise(strings()))
    staged = df.withColumn("_kept", kept)
    one = F.filter(chunks, lambda c: (normalize_text(c) != "") | (F.lit(False) if spared is None else spared))
    return staged.withColumn(column, F.when(several, pick(chunks, F.col("_kept"))).otherwise(one)).drop("_kept")


def fast_chunks(
    df: DataFrame, text: str, output: str = "chunks", min_chars: int = fixed.MIN_CHARS, max_chars: int = fixed.MAX_CHARS
) -> DataFrame:
    """Add the array of sentence-packed, near-duplicate-free chunks of ``text``; a text that is not packed is not compared either."""
    df = deal(df, text, df, LOT_BYTES)
    packed = df.withColumn(output, pack_sentences(F.col(text), min_chars, max_chars))
    return dedup_chunks(packed, output, spared=_not_packed(F.col(text), min_chars, max_chars))


def contextual_chunks(
    df: DataFrame,
    text: str,
    output: str = "chunks",
    category: Column | None = None,
    min_chars: int = fixed.MIN_CHARS,
    max_chars: int = fixed.MAX_CHARS,
    overlap: int = fixed.CONTEXT_WINDOW,
    heading_prefix: bool = True,
) -> DataFrame:
    """Add the array of heading-aware chunks of ``text``.

    Sections are cut at headings, numbered sections at their clauses, everything else is packed by
    sentence; pieces get overlap inside their section and their heading as a prefix.
    """
    ship_package(df.sparkSession)
    df = deal(df, text, df, LOT_BYTES)
    low = effective_min(min_chars)
    source = strip(F.coalesce(F.col(text), F.lit("")))
    group = category if category is not None else F.lit("")

    def units(section: Column) -> Column:
        plain = F.array(
            F.struct(section["heading"].alias("heading"), section["body"].alias("text"), F.lit(False).alias("numbered"))
        )
        return let(
            split_numbered(section["heading"], section["body"]),
            lambda n: F.when(n.isNull(), plain).otherwise(
                F.transform(
                    n, lambda u: F.struct(u["heading"].alias("heading"), u["text"].alias("text"), F.lit(True).alias("numbered"))
                )
            ),
        )

    def raw_pieces(u: Column) -> Column:
        direct = u["numbered"] & (F.length(u["text"]) <= max_chars)
        return F.when(direct, strings(u["text"])).otherwise(pack_sentences(u["text"], min_chars, max_chars))

    staged = (
        df.withColumn("_text", source)
        .withColumn("_units", F.flatten(F.transform(split_sections(F.col("_text")), units)))
        .withColumn("_raw", F.transform("_units", raw_pieces))
    )
    several = F.transform("_raw", lambda a: F.when(F.size(a) > 1, _normalized(a)).otherwise(strings()))
    staged = staged.withColumn("_kept", kept_positions_nested(fixed.DEDUP_GATE_CHUNKS)(several))

    def finish(u: Column, i: Column) -> Column:
        raw, kept = F.get(F.col("_raw"), i), F.get(F.col("_kept"), i)
        headed = (u["heading"] != "") if heading_prefix else F.lit(False)

        def prefixed(c: Column) -> Column:
            return with_heading(c, u["heading"], group) if heading_prefix else c

        def numbered(pieces: Column) -> Column:
            usable = F.filter(pieces, lambda c: F.length(strip(c)) >= fixed.MIN_FLOOR)
            return F.transform(usable, lambda c: let(prefixed(c), lambda p: _shorten(p, headed, max_chars, None)))

        def plain(pieces: Column) -> Column:
            joined = _join_short(pieces, low, max_chars + fixed.COALESCE_EXTRA)
            widened = let(joined, lambda j: add_overlap(j, overlap)) if overlap > 0 else joined
            return F.transform(widened, lambda c: let(prefixed(c), lambda p: _shorten(p, headed, max_chars, low)))

        def nonempty(pieces: Column) -> Column:
            return F.when(
                (F.size(pieces) == 0) & (F.length(strip(u["text"])) >= fixed.MIN_FLOOR), slices(u["text"], max_chars)
            ).otherwise(pieces)

        pieces = F.when(F.size(raw) > 1, pick(raw, kept)).otherwise(raw)
        return let(
            let(pieces, nonempty),
            lambda p: F.when(u["numbered"], numbered(p)).otherwise(plain(p)),
        )

    long_enough = F.filter(F.flatten(F.transform("_units", finish)), lambda c: F.length(strip(c)) >= fixed.MIN_FLOOR)
    whole = F.when(F.length("_text") >= fixed.MIN_FLOOR, strings(F.substring("_text", 1, max_chars))).otherwise(strings())
    result = staged.withColumn(
        output,
        F.when(F.col("_text") == "", strings()).otherwise(
            let(long_enough, lambda c: F.when(F.size(c) > 0, c).otherwise(whole))
        ),
    )
    return dedup_chunks(result, output).drop("_text", "_units", "_raw", "_kept")
