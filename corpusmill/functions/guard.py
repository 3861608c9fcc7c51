"""Handling of untrusted text: input cleaning, prompt-injection signs, answer checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.arrays import let
from corpusmill.functions.text import SPACE, strip

_PARAMETER = (
    r"(?i)\b(rerank|top_k|top-k|use_rerank|use_history|show_context|category)"
    rf"[{SPACE}]*[:=][{SPACE}]*(true|false|\d+|[a-z_]+)"
)
_INJECTION = "(?iu)" + "|".join(fixed.INJECTION_PATTERNS).replace(r"\s", f"[{SPACE}]")
_FORBIDDEN = "(?iu)" + "|".join(fixed.FORBIDDEN_OUTPUT_PATTERNS).replace(r"\s", f"[{SPACE}]")


def detect_injection(text: Column) -> Column:
    return F.coalesce(text.rlike(_INJECTION), F.lit(False))


def sanitize_input(text: Column, max_len: int = 2000) -> Column:
    """Cut, drop control characters and pasted parameters, collapse white space, trim separators."""
    t = F.substring(F.coalesce(text, F.lit("")), 1, max_len)
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, _PARAMETER, "")
    t = F.regexp_replace(t, rf"(?i)[•|][{SPACE}]*(rerank|top_k)[^\n]*", "")
    t = strip(F.regexp_replace(t, rf"[{SPACE}]+", " "))
    return F.btrim(t, F.lit(" •|-,"))


def wrap_untrusted(text: Column, max_chars: int = 4000) -> Column:
    """Put data between markers; markers inside the data are disarmed."""
    start, end = F.lit(fixed.DATA_START + "\n"), F.lit("\n" + fixed.DATA_END)
    safe = F.replace(F.replace(text, F.lit(fixed.DATA_START), F.lit("[DATA_START]")), F.lit(fixed.DATA_END), F.lit("[DATA_END]"))
    cut = F.when(
        F.length(safe) > max_chars, F.concat(F.substring(safe, 1, max_chars), F.lit(fixed.MSG_TRUNCATED_DATA))
    ).otherwise(safe)
    body = F.when(F.coalesce(text, F.lit("")) == "", F.lit(fixed.MSG_EMPTY_DATA)).otherwise(cut)
    return F.concat(start, body, end)


def sanitize_history(history: Column, max_items: int = 20, max_chars: int = 600) -> Column:
    """Last messages with known roles; system messages are wrapped, empty ones dropped."""
    count = F.least(F.size(history), F.lit(max_items))
    recent = F.slice(history, F.greatest(F.size(history) - count + 1, F.lit(1)), count)

    def tidy(m: Column) -> Column:
        role = F.when(m["role"].isin("user", "assistant", "system"), m["role"]).otherwise("user")
        cut = F.substring(F.coalesce(m["content"], F.lit("")), 1, max_chars)
        content = F.when(role == "system", wrap_untrusted(cut)).otherwise(sanitize_input(cut, max_chars))
        return F.struct(role.alias("role"), content.alias("content"))

    return F.filter(F.transform(recent, tidy), lambda m: m["content"] != "")


def _last_of(text: Column, marks: list[str]) -> Column:
    """Zero-based position of the last occurrence of any mark, -1 if there is none."""
    size = F.length(text)

    def last(mark: str) -> Column:
        found = F.instr(F.reverse(text), mark[::-1])
        return F.when(found > 0, size - found - len(mark) + 1).otherwise(-1)

    return F.greatest(*[last(m) for m in marks])


def validate_output(answer: Column, max_len: int = fixed.MAX_ANSWER_CHARS, refuse: bool = True) -> Column:
    """Checked answer text: bounded, without leaked instructions, echoes of attacks or scripts.

    An answer that is hardly more than a leak is refused as a whole; without ``refuse`` its leak is hidden like any other.
    """

    def shorten(a: Column) -> Column:
        cut = F.substring(a, 1, max_len)
        end = _last_of(cut, [".", "!", "?", "。", "\n\n"])
        at_sentence = F.concat(F.substring(cut, F.lit(1), end + 1), F.lit(fixed.MSG_CUT_SENTENCE))
        anywhere = F.concat(F.regexp_replace(cut, rf"[{SPACE}]+$", ""), F.lit(fixed.MSG_CUT))
        whole = F.when((end > max_len - 600) & (end > 0), at_sentence).otherwise(anywhere)
        return F.when(F.length(a) > max_len, whole).otherwise(a)

    def hide(a: Column) -> Column:
        found = F.length(F.regexp_extract(a, "(" + _FORBIDDEN + ")", 1))
        hidden = F.regexp_replace(a, _FORBIDDEN, fixed.MSG_HIDDEN)
        mostly = (found > F.length(a) * 0.5) & (F.length(a) < 500)
        bare = F.length(strip(hidden)) < 20
        blocked = bare & (mostly | (found > 100))
        shown = F.when(blocked, F.lit(fixed.MSG_NO_SYSTEM)).otherwise(hidden) if refuse else hidden
        return F.when(found == 0, a).otherwise(shown)

    def finish(a: Column) -> Column:
        clean = F.replace(F.replace(a, F.lit(fixed.DATA_START), F.lit("")), F.lit(fixed.DATA_END), F.lit(""))
        low = F.lower(clean)
        echo = (
            detect_injection(clean) & (F.length(clean) < 200)
            & low.rlike("ignore|disregard|system:|jailbreak")
        )
        safe = F.regexp_replace(clean, r"(?is)<script.*?>.*?</script>", fixed.MSG_SCRIPT)
        safe = F.regexp_replace(safe, rf"(?i)javascript[{SPACE}]*:", fixed.MSG_REMOVED)
        return F.when(echo, F.lit(fixed.MSG_REFUSED)).otherwise(strip(safe))

    checked = let(let(let(answer, shorten), hide), lambda h: F.when(
        h == fixed.MSG_NO_SYSTEM, F.lit(fixed.MSG_NO_SYSTEM)
    ).otherwise(finish(h)))
    return F.when(F.coalesce(answer, F.lit("")) == "", F.lit(fixed.MSG_NO_SOURCE)).otherwise(checked)


def validate_sources(sources: Column, limit: int = 10) -> Column:
    """At most ten sources as maps of five known fields, each cut to 200 characters, without path tricks."""
    names = ["filename", "category", "subcategory", "page", "source"]

    def field(s: Column, name: str) -> Column:
        cut = F.substring(s[name].cast("string"), 1, 200)
        return F.replace(F.replace(cut, F.lit(".."), F.lit("")), F.lit("\\"), F.lit("/"))

    cleaned = F.transform(
        F.slice(sources, 1, limit), lambda s: F.struct(*[field(s, n).alias(n) for n in names])
    )
    return F.filter(cleaned, lambda s: F.coalesce(*[s[n] for n in names]).isNotNull())


def question_problem(question: Column, top_k: Column, category: Column, style: Column) -> Column:
    """First reason a request is not acceptable, or null."""
    return (
        F.when(strip(F.coalesce(question, F.lit(""))) == "", "empty")
        .when(F.length(question) > 2000, "too_long")
        .when(sanitize_input(question) == "", "empty_after_cleaning")
        .when(top_k.isNotNull() & ~top_k.between(1, 10), "top_k")
        .when(category.isNotNull() & ~strip(category).isin(fixed.CATEGORY_ORDER), "category")
        .when(style.isNotNull() & ~style.isin(fixed.STYLES), "style")
    )


def session_name(session_id: Column) -> Column:
    """A usable session id: letters, digits, - and _; null if nothing usable or too long."""
    sid = strip(session_id)
    kept = F.substring(F.regexp_replace(sid, r"[^a-zA-Z0-9\-_]", ""), 1, 64)
    return (
        F.when(F.length(sid) > 128, F.lit(None))
        .when(sid.rlike(r"^[a-zA-Z0-9\-_]+$"), sid)
        .otherwise(F.nullif(kept, F.lit("")))
    )


def tool_allowed(tool: Column) -> Column:
    return tool.isin("retrieve", "rerank", "calculate", "generate")
