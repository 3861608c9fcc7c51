"""Question classifiers and the route a question takes; word lists are in ``fixed``.

With ``parity=True`` the small-talk and style word lists match anywhere in the text, so that short
words also match inside longer ones; by default they match whole words.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import fixed
from corpusmill.functions.arrays import let
from corpusmill.functions.text import WORD, any_of, contains_any, fold, holds_any, strip, strip_accents


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _has(text: Column, words: list[str], whole: bool) -> Column:
    if not whole:
        return contains_any(text, words)
    return text.rlike(rf"(?<![{WORD}])(?:{any_of([w.strip() for w in words])})(?![{WORD}])")


def _plain(words: list[str]) -> list[str]:
    def one(word: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")

    return list(dict.fromkeys(one(w) for w in words))


def words_in(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.size(F.filter(F.split(strip(text), r"\s+"), lambda w: w != ""))


def detect_style(question: Column, parity: bool = False) -> Column:
    """Answer style asked for, or null. The order of the styles decides between several."""
    q = _low(question)
    clause = _has(q, fixed.STYLE_CLAUSE_WORDS, not parity)
    intent = _has(q, fixed.STYLE_INTENT, not parity)
    named = F.coalesce(*[F.when(_has(q, words, not parity), F.lit(s)) for s, words in fixed.STYLE_WORDS.items()])
    return (
        F.when(strip(q) == "", F.lit(None))
        .when(clause & contains_any(q, fixed.STYLE_CLAUSE_DETAIL), "detailed")
        .when(intent, named)
        .when(contains_any(q, fixed.STYLE_PLAIN_ALONE), "plain")
        .when(clause, "detailed")
    )


def strip_style(question: Column) -> Column:
    """The question without its style instruction; empty if nothing else was said.

    Only the first style word (in list order) is looked at. What follows it counts as the question
    from the first joining word or comma on, when that leaves more than five characters.
    """
    words = [w for group in fixed.STYLE_WORDS.values() for w in group]
    q = _low(question)
    first = F.coalesce(*[F.when(F.contains(q, F.lit(w)), F.lit(w)) for w in words])
    joiners = ["và", "rồi", ",", ";", "và cho", "và hãy"]

    def after(word: Column) -> Column:
        rest = F.substring(question, F.instr(q, word) + F.length(word), F.length(question))
        return F.btrim(rest, F.lit(" :,-."))

    def tail(rest: Column) -> Column:
        low = F.lower(rest)

        def cut(joiner: str) -> Column:
            at = F.instr(low, joiner)
            part = strip(F.substring(rest, at + len(joiner), F.length(rest)))
            return F.when((at > 0) & (F.length(part) > 5), part)

        bare = (F.length(rest) < 15) | low.rlike("^(?:đi|nhé|nha)")
        return F.coalesce(*[cut(j) for j in joiners], F.when(bare, F.lit("")), question)

    return F.when(first.isNull(), question).otherwise(let(let(first, after), tail))


def is_recall(question: Column) -> Column:
    """Asks about the conversation itself."""
    q = _low(question)
    triple = F.lit(True)
    for group in fixed.RECALL_TRIPLE:
        triple = triple & contains_any(q, group)
    return contains_any(q, fixed.RECALL_WORDS) | triple


def needs_rewrite(question: Column, has_history: Column) -> Column:
    """Depends on earlier turns: very short, a pronoun, or a bare follow-up."""
    q = F.lower(strip(F.coalesce(question, F.lit(""))))
    bare = F.lit(False)
    for follow_up in fixed.SHORT_FOLLOW_UPS:
        bare = bare | q.startswith(follow_up)
    tokens = F.transform(F.split(q, r"\s+"), lambda w: F.btrim(w, F.lit(".,?:;!\"'")))
    pronoun = F.array_contains(tokens, "nó") | F.array_contains(tokens, "no")
    return has_history & (
        (F.length(q) < 15) | bare | contains_any(q, fixed.PRONOUN_WORDS) | pronoun | (words_in(q) <= 4)
    )


def rewrite_with_history(question: Column, history: Column) -> Column:
    """Stand-alone form of a dependent question, from the first or last user question before it.

    The rule used when no language model is given: a pronoun is replaced by the earlier question, a
    short question without one gets the opening question as an addition.
    """
    q = F.lower(strip(question))
    asked = F.filter(
        history, lambda m: (m["role"] == "user") & (strip(F.coalesce(m["content"], F.lit(""))) != "")
    )
    texts = F.transform(asked, lambda m: strip(m["content"]))
    opening = F.get(texts, F.lit(0))
    last = F.try_element_at(F.filter(texts, lambda t: F.lower(t) != q), F.lit(-1))
    vague = q.rlike(any_of([" nó", "cái đó", "cái này", "trong đó", "ở trên", "như trên"]))
    referent = F.when(vague, F.coalesce(opening, last)).otherwise(F.coalesce(last, opening))
    pronoun = F.coalesce(*[F.when(F.contains(q, F.lit(p)), F.lit(p)) for p in fixed.REWRITE_PRONOUNS])
    brief = F.regexp_replace(F.substring(referent, 1, 80), r"[?.]+$", "")
    swapped = strip(F.replace(F.lower(question), pronoun, brief))
    capital = F.concat(F.upper(F.substring(swapped, 1, 1)), F.substring(swapped, F.lit(2), F.length(swapped)))
    inline = F.replace(F.replace(question, F.lit("nó"), F.substring(referent, 1, 60)), F.lit("Nó"), F.substring(referent, 1, 60))
    replaced = F.when(pronoun.isNull(), question).when(words_in(question) <= 4, capital).otherwise(inline)
    better = (F.lower(strip(replaced)) != q) & (F.length(replaced) > F.length(question))
    added = F.concat(question, F.lit(" (liên quan đến: "), F.substring(opening, 1, 80), F.lit(")"))
    dependent = needs_rewrite(question, F.size(F.coalesce(history, F.array())) > 0)
    return (
        F.when(~dependent | referent.isNull(), question)
        .when(better, replaced)
        .when((words_in(question) <= 6) & opening.isNotNull(), added)
        .otherwise(question)
    )


def is_social(question: Column, has_history: Column | None = None, parity: bool = False) -> Column:
    """Small talk by word list; professional words, recall and dependent questions never are.

    Questions no list decides are ``False``: a classifier model is the caller's to add.
    """
    history = has_history if has_history is not None else F.lit(False)
    low, plain = F.lower(strip(F.coalesce(question, F.lit("")))), fold(question)

    def listed(words: list[str], whole: bool) -> Column:
        return _has(low, words, whole) | _has(plain, _plain(words), whole)

    excluded = is_recall(question) | listed(fixed.PROFESSIONAL_WORDS, False) | needs_rewrite(question, history)
    return (low != "") & ~excluded & listed(fixed.SOCIAL_WORDS, not parity)


def unclear_reason(question: Column, has_history: Column, standalone: Column | None = None) -> Column:
    """Why a question is too vague to answer, or null."""
    q = strip(F.coalesce(question, F.lit("")))
    low, size, words = F.lower(q), F.length(q), words_in(q)
    vague, professional = contains_any(low, fixed.VAGUE_PHRASES), contains_any(low, fixed.PROFESSIONAL_WORDS_WIDE)
    short_vague = vague & (size < 30)
    again = F.coalesce(contains_any(F.lower(standalone), fixed.STANDALONE_VAGUE), F.lit(False)) if standalone is not None else F.lit(False)
    return (
        F.when(q == "", "empty")
        .when((size < 8) & ~has_history, "too_short_no_history")
        .when((size < 8) & low.isin(fixed.VAGUE_BARE), "too_short_pronoun")
        .when(short_vague & contains_any(low, fixed.VAGUE_THAT) & (words <= 6), "vague_with_that_short")
        .when(short_vague & ~professional, "vague_no_professional")
        .when(short_vague & contains_any(low, fixed.VAGUE_SHORT) & (size < 25), "vague_short")
        .when(again, "standalone_still_vague")
        .when(~professional & (words <= 3) & (size < 20), "too_generic")
    )


def clarification(question: Column) -> Column:
    """What to ask back."""
    low = _low(question)
    that = F.contains(low, F.lit("đó"))
    tail = (
        F.when(F.contains(low, F.lit("quy định")) & that, fixed.CLARIFY_RULE)
        .when(F.contains(low, F.lit("quy chế")) & that, fixed.CLARIFY_STATUTE)
        .otherwise(fixed.CLARIFY_HINTS)
    )
    return F.concat(F.lit(fixed.CLARIFY_BASE), tail)


def file_intent(text: Column) -> Column:
    """struct<has_request, extracted_query>: whether an uploaded text itself asks for something.

    Undecided texts (a single mark of a request) are reported by ``has_request`` null, for a model.
    """
    forms = let(strip(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("txt"), F.lower(t).alias("low")))
    keywords = list(dict.fromkeys(fixed.IMPERATIVE_WORDS + _plain(fixed.IMPERATIVE_WORDS)))

    def signs(f: Column) -> Column:
        """What decides, looked for once: a lambda evaluates what it names each time."""

        def anywhere(words: list[str]) -> Column:
            return holds_any(f["low"], words) | holds_any(f["plain"], words)

        return F.struct(
            *[f[c].alias(c) for c in ("txt", "low", "plain")], F.regexp_count(f["txt"], F.lit(r"\?")).alias("marks"),
            anywhere(keywords).alias("keyword"), anywhere(fixed.STRONG_IMPERATIVES).alias("strong"),
        )

    return let(let(let(forms, lambda f: f.withField("plain", strip_accents(f["low"]))), signs), lambda f: _file_intent(f, keywords))


def _file_intent(f: Column, keywords: list[str]) -> Column:
    txt, low, plain, marks, has_keyword, strong = (f[c] for c in ("txt", "low", "plain", "marks", "keyword", "strong"))
    at = F.coalesce(
        *[
            F.when(F.contains(low, F.lit(k)), F.instr(low, k)).when(F.contains(plain, F.lit(k)), F.instr(plain, k))
            for k in keywords
        ],
        F.lit(1),
    )

    def around(position: Column, before: int, length: int) -> Column:
        start = F.greatest(position - before, F.lit(1))
        return strip(F.substring(txt, start, F.lit(length)))

    first_mark = F.instr(txt, "?")
    # 200 characters on either side of the first mark. Nearer to the start, the left edge counts from the
    # text's end instead: a short text is taken whole, a long one has no passage there.
    mark = first_mark - 1
    left = F.when(mark >= 200, mark - 200).otherwise(F.greatest(F.length(txt) + mark - 200, F.lit(0)))
    near_mark = strip(F.substring(txt, left + 1, F.greatest(mark + 200 - left, F.lit(0))))
    lead = F.array_join(
        F.slice(F.filter(F.split(txt, r"[?。\n]"), lambda s: strip(s) != ""), 1, 3), "\n"
    )
    window = F.least(at - 1, F.lit(200)) + 500
    start = F.greatest(at - 200, F.lit(1))
    by_keyword = strip(F.substring(txt, start, window))
    query = (
        F.when(marks >= 2, F.coalesce(F.nullif(near_mark, F.lit("")), F.substring(lead, 1, 1000)))
        .when(strong, around(at, 200, 800))
        .when(has_keyword & (marks >= 1), by_keyword)
        .otherwise("")
    )
    undecided = has_keyword | (marks == 1) | (words_in(txt) < 50)
    decided = (marks >= 2) | strong | (has_keyword & (marks >= 1))
    request = F.when(txt == "", F.lit(False)).when(decided, F.lit(True)).when(~undecided, F.lit(False))
    return F.struct(request.alias("has_request"), query.alias("extracted_query"))


def is_truncated(text: Column, token_limit_reached: Column | None = None) -> Column:
    """Whether an answer looks cut off in the middle."""
    s = strip(F.coalesce(text, F.lit("")))
    low_tail = F.lower(F.substring(s, F.greatest(F.length(s) - 79, F.lit(1)), F.lit(80)))

    def tail_has_stop(chars: int) -> Column:
        return F.substring(s, F.greatest(F.length(s) - chars + 1, F.lit(1)), F.lit(chars)).rlike("[.!?。]")

    cited = s.endswith("]")
    closed = s.rlike(r"[.!?。！？\"'”’)\]]$")
    cited_cut = (F.length(s) > 1500) & low_tail.rlike("thuộc|khối|đảng")
    dangling = low_tail.rlike("(?:" + any_of([w.strip() for w in fixed.DANGLING_ENDINGS]) + ")$")
    last_60 = F.substring(s, F.greatest(F.length(s) - 59, F.lit(1)), F.lit(60))
    open_end = s.rlike(r"[\p{L}\p{N}]$") & ~last_60.rlike("[.!?。！？]")
    long_open = open_end & (
        (F.length(s) > 50)
        | ((F.regexp_count(s, F.lit(r"\|")) % 2 == 1) & F.contains(s, F.lit("\n|")))
        | ((F.length(s) > 20) & s.rlike(r"\p{L}$") & (words_in(s) > 3))
    )
    limit = F.coalesce(token_limit_reached, F.lit(False)) if token_limit_reached is not None else F.lit(False)
    return (
        F.when(s == "", F.lit(False))
        .when(cited & F.contains(F.element_at(F.split(s, "\n"), -1), F.lit("[")), ~tail_has_stop(40) & cited_cut)
        .when(closed & ~cited, F.lit(False))
        .when(cited & tail_has_stop(30), F.lit(False))
        .otherwise(dangling | long_open | limit)
    )


def self_check(question: Column, answer: Column, contexts: Column) -> Column:
    """struct<sufficient, reason>: whether an answer is backed by its context."""
    a = strip(F.coalesce(answer, F.lit("")))
    low = F.lower(a)
    words = F.slice(
        F.filter(F.split(_low(question), rf"[^{WORD}]+"), lambda w: F.length(w) > 4), 1, 4
    )
    joined = F.array_join(F.transform(contexts, lambda c: F.lower(F.coalesce(c, F.lit("")))), " ")
    missed = (F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(joined, w))
    uncited = ~(F.contains(a, F.lit("[")) & F.contains(a, F.lit("]")))
    reason = (
        F.when(a == "", "empty_answer")
        .when(F.coalesce(F.size(contexts), F.lit(0)) == 0, "no_context")
        .when(low.rlike("không đủ nguồn|khong du nguon"), "admitted_lack")
        .when(uncited & (F.length(a) > 300), "missing_citation")
        .when(missed, "keyword_miss")
        .otherwise("ok")
    )
    return let(reason, lambda r: F.struct(r.isin("ok", "admitted_lack").alias("sufficient"), r.alias("reason")))


def wants_retry(check: Column, attempts: Column, max_steps: int = 3) -> Column:
    return ~check["sufficient"] & (attempts < max(1, min(5, max_steps)))


def retry_query(standalone: Column, question: Column, attempts: Column) -> Column:
    """A retry repeats the original question behind the query."""
    longer = F.substring(strip(F.concat_ws(" ", standalone, question)), 1, 1000)
    return F.when(attempts > 0, longer).otherwise(standalone)


def social_reply(question: Column, about: str = fixed.SOCIAL_OTHER) -> Column:
    """Fixed replies used when no model is given; ``about`` answers who is speaking."""
    q = _low(question)
    reply = F.when(F.lit(False), F.lit(""))
    for words, text in [*fixed.SOCIAL_REPLIES, (fixed.SOCIAL_WHO_WORDS, about)]:
        reply = reply.when(contains_any(q, words), F.lit(text))
    return reply.otherwise(F.lit(fixed.SOCIAL_OTHER))


def style_reply(drafted: Column, style: Column) -> Column:
    """A model's confirmation of a style, or the fixed one if it doesn't speak of a style."""
    plain = F.concat(F.lit(fixed.STYLE_CONFIRMED), style, F.lit(fixed.STYLE_CONFIRMED_END))
    return F.when(F.contains(F.lower(F.coalesce(drafted, F.lit(""))), F.lit(fixed.STYLE_CONFIRM_WORD)), drafted).otherwise(plain)


def recall_reply(drafted: Column, history: Column) -> Column:
    """A model's answer about the conversation, or the list of the user's questions if it found nothing."""
    asked = F.transform(F.filter(history, lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit("")))
    listing = F.array_join(F.transform(asked, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    told = F.concat(F.lit(fixed.RECALL_LISTING), listing, F.lit(fixed.RECALL_FIRST), F.get(asked, F.lit(0)), F.lit('"'))
    fallback = (
        F.when(F.coalesce(F.size(history), F.lit(0)) == 0, F.lit(fixed.RECALL_NO_HISTORY))
        .when(F.size(asked) == 0, F.lit(fixed.RECALL_NO_QUESTION))
        .otherwise(told)
    )
    said = F.coalesce(drafted, F.lit(""))
    return F.when((said != "") & ~F.contains(F.lower(said), F.lit(fixed.RECALL_LACK)), drafted).otherwise(fallback)


def route(
    question: Column, history: Column, math_kind: Column, parity: bool = False
) -> Column:
    """Which branch answers: style, recall, multi_math, comparison, math, social, unclear or retrieve.

    ``math_kind`` comes from ``calc.math_kind``; an instruction that leaves no question is 'style'.
    """
    has_history = F.size(F.coalesce(history, F.array())) > 0
    styled = detect_style(question, parity).isNotNull() & (strip_style(question) == "")
    return (
        F.when(styled, "style")
        .when(has_history & is_recall(question), "recall")
        .when(math_kind.isNotNull(), math_kind)
        .when(is_social(question, has_history, parity), "social")
        .when(unclear_reason(question, has_history).isNotNull(), "unclear")
        .otherwise("retrieve")
    )
