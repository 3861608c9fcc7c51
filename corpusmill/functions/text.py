"""Text normalisation, tokenisation, cleaning and sentence splitting as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.arrays import let

# Java's \s is ASCII only; these are the remaining characters Unicode calls white space.
SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same class without the characters that end a line.
INLINE_SPACE = r" \t\x1f\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_BREAKS = [c for c in SPACE_CHARS if c != "\n" and c.splitlines() == [""]]
_INLINE_SPACES = [c for c in SPACE_CHARS if c not in [" ", "\n", *_BREAKS]]
WORD = r"\p{L}\p{N}_"
CUT = "\ue001"  # private-use character: marks a place to split
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def any_of(words: list[str]) -> str:
    """Regular expression for 'contains one of these literal strings'."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def contains_any(col: Column, words: list[str]) -> Column:
    return col.rlike(any_of(words))


def holds_any(col: Column, words: list[str]) -> Column:
    """``contains_any`` for a value at hand and long lists: a byte search a word instead of every alternative at every character."""
    return reduce(lambda found, w: found | F.contains(col, F.lit(w)), words, F.lit(False))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: accented letters first, then marks to be deleted."""
    letters, bases, marks = [], [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF)):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            letters.append(ch)
            bases.append(base)
    return "".join(letters + marks), "".join(bases)


def strip_accents(col: Column) -> Column:
    """Drop combining marks and map accented letters to their base letter (đ has no base and stays)."""
    src, dst = _accent_table()
    return F.translate(col, src, dst)


def normalize_text(col: Column, accents: bool = True) -> Column:
    """Lower-cased words separated by single blanks: the comparison form used for duplicate keys."""
    low = F.lower(F.coalesce(col, F.lit("")))
    if not accents:
        low = strip_accents(low)
    return F.trim(F.regexp_replace(low, rf"[^{WORD}]+", " "))


def text_key(col: Column) -> Column:
    return F.md5(normalize_text(col).cast("binary"))


def tokenize(col: Column, min_length: int = 2) -> Column:
    """Lower-cased word tokens of at least ``min_length`` characters, repeats kept, in order."""
    parts = F.split(F.lower(F.coalesce(col, F.lit(""))), rf"[^{WORD}]+")
    return F.filter(parts, lambda w: F.length(w) >= min_length)


def ascii_tokens(col: Column) -> Column:
    """Accent-free [a-z0-9_] tokens of at least two characters, as the answer metrics use them."""
    plain = strip_accents(F.lower(F.coalesce(col, F.lit(""))))
    parts = F.split(plain, r"[^a-z0-9_]+")
    return F.filter(parts, lambda w: F.length(w) >= 2)


def fold(col: Column) -> Column:
    """Lower-cased, accent-free text for accent-insensitive 'contains' tests."""
    return strip_accents(F.lower(F.coalesce(col, F.lit(""))))


def _noise_line() -> str:
    whole = "|".join(fixed.NOISE_WHOLE_LINE).replace(r"\s", "[" + INLINE_SPACE + "]")
    start = "|".join(fixed.NOISE_LINE_START).replace(r"\s", "[" + INLINE_SPACE + "]")
    ruler = fixed.RULER_CHARACTERS
    space = f"[{INLINE_SPACE}]"
    return (
        rf"(?miud)^{space}*(?:(?:{whole})|[{ruler}][{INLINE_SPACE}{ruler}]+[{ruler}]|(?:{start})[^\n]*){space}*$"
    )


def is_noise_line(line: Column) -> Column:
    """True for letterhead, page number, signature and ruler lines."""
    return line.rlike(_noise_line())


def clean_text(col: Column) -> Column:
    """Drop noise lines and boilerplate, unify dashes, collapse blanks, drop empty lines.

    Works on the whole text with line-anchored patterns instead of looping over an array of lines. A
    pattern with a wide class of characters runs only on texts that hold one of them, which byte searches tell.
    """

    def where(has: Callable[[Column], Column], change: Callable[[Column], Column], otherwise=lambda t: t) -> Callable[[Column], Column]:
        return lambda t: F.when(has(t), change(t)).otherwise(otherwise(t))

    steps = [
        where(lambda t: holds_any(t, _BREAKS), lambda t: F.regexp_replace(t, LINE_BREAK, "\n")),
        lambda t: F.regexp_replace(t, _noise_line(), ""),
        where(lambda t: F.contains(t, F.lit("(")), lambda t: F.regexp_replace(t, "(?iu)" + fixed.ENACTMENT_NOTE, "")),
        where(lambda t: F.contains(t, F.lit("/")), lambda t: F.regexp_replace(t, "(?iu)" + fixed.DOCUMENT_CODE, "")),
        where(lambda t: holds_any(t, ["–", "—"]), lambda t: F.translate(t, "–—", "--")),
        where(
            lambda t: holds_any(t, _INLINE_SPACES),
            lambda t: F.regexp_replace(t, rf"[{INLINE_SPACE}]+", " "),
            lambda t: F.regexp_replace(t, "  +", " "),
        ),
        lambda t: F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n")),
    ]
    return reduce(let, steps, F.coalesce(col, F.lit("")))


def lines(col: Column) -> Column:
    """Array of lines; an ending line break does not open a further empty line."""
    t = F.regexp_replace(F.coalesce(col, F.lit("")), LINE_BREAK, "\n")
    return F.split(F.regexp_replace(t, r"\n\z", ""), "\n")


def split_sentences(col: Column) -> Column:
    """Sentences end at . ! or ? before white space; they are trimmed and empty ones dropped."""
    marked = F.regexp_replace(col, rf"([.!?])[{SPACE}]+", "$1" + CUT)
    parts = F.transform(F.split(marked, CUT), strip)
    return F.filter(parts, lambda s: s != "")


def visual_type(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    return (
        F.when(contains_any(low, fixed.CHART_WORDS), "chart_or_diagram")
        .when(contains_any(low, fixed.ILLUSTRATION_WORDS), "illustration")
        .otherwise("image")
    )


def posix_path(col: Column) -> Column:
    return F.replace(col, F.lit("\\"), F.lit("/"))
