"""Values at given positions of a sorted column, without sorting it.

All positions are narrowed together by rounds of histograms. A round counts, for each open bracket of
values, its rows in ``BINS`` bins of equal width, with the least and greatest value of each bin; a task
sends one row per bin at most, and so does the whole job to the driver. The bin that holds a position is its next bracket. The
first brackets come from a quantile sketch, so two or three rounds do for any number of rows. A
bracket whose least and greatest values agree is done, however many rows have that value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Accuracy of the sketch that gives the first brackets.
ACCURACY = 10_000


@dataclass(frozen=True)
class Bracket:
    """The rows from ``low`` to ``high``; ``before`` rows are smaller, ``rows`` are inside."""

    low: float
    high: float
    before: int
    rows: int


def _bin(value: Column, b: Bracket) -> Column:
    """Number of the bin; monotone in the value, which is all that narrowing needs."""
    if math.isfinite(b.high - b.low):
        share = (value - b.low) / F.lit(b.high - b.low)
    else:  # wider than the largest number
        share = (value / 2 - b.low / 2) / F.lit(b.high / 2 - b.low / 2)
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def _first_brackets(finite: DataFrame, rows: int, positions: Sequence[int]) -> dict[int, Bracket]:
    """Brackets between neighbouring sketch quantiles around each position; exact counts decide which of them holds it."""
    margin = 5.0 / ACCURACY
    shares = sorted({min(1.0, max(0.0, (p + 0.5) / rows + d)) for p in positions for d in (-margin, margin)} | {0.0, 1.0})
    cuts = finite.agg(F.percentile_approx("v", shares, ACCURACY).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    edges = sorted({cuts.lo, cuts.hi, *cuts.c})
    # Part i holds the values above edge i - 1, up to edge i.
    part = F.lit(0)
    for e in edges[:-1]:
        part = part + (F.col("v") > F.lit(e)).cast("int")
    found = finite.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    return _holding([(r.lo, r.hi, r.n) for r in sorted(found, key=lambda r: r.part)], 0, positions)


def _holding(parts: list[tuple[float, float, int]], before: int, positions: Sequence[int]) -> dict[int, Bracket]:
    out, at = {}, before
    for low, high, n in parts:
        out |= {p: Bracket(low, high, at, n) for p in positions if at <= p < at + n}
        at += n
    return out


def values_at(df: DataFrame, value: str, positions: Callable[[int], Sequence[int]]) -> list[float | None]:
    """Exact values at the zero-based ``positions(n)`` of the ``n`` values that are not null, in ascending order.

    NaN comes last, as Spark orders it. A position outside 0 .. n - 1 gives None, and so does every position of an empty column.
    """
    clean = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    inf, nan = F.lit(float("inf")), F.isnan("v")
    n, least, most, none = clean.agg(
        F.count("*"), F.count(F.when(F.col("v") == -inf, 1)), F.count(F.when((F.col("v") == inf) & ~nan, 1)), F.count(F.when(nan, 1))
    ).first()
    wanted = list(positions(n))
    known = {p: None for p in wanted if not 0 <= p < n}
    known |= {p: float("-inf") for p in wanted if 0 <= p < least}
    known |= {p: float("nan") for p in wanted if n - none <= p < n}
    known |= {p: float("inf") for p in wanted if n - none - most <= p < n - none}
    open_ = sorted({p - least for p in wanted if p not in known})
    if open_:
        finite = clean.where(~nan & (F.abs("v") < inf))
        brackets = _first_brackets(finite, n - none - most - least, open_)
        while True:
            known |= {p + least: b.low for p, b in brackets.items() if b.low == b.high}
            todo = sorted({b for b in brackets.values() if b.low < b.high}, key=lambda b: b.low)
            if not todo:
                break
            which, place = F.lit(None).cast("int"), F.lit(None).cast("int")
            for i, b in enumerate(todo):
                inside = F.col("v").between(b.low, b.high)
                which, place = F.when(inside, F.lit(i)).otherwise(which), F.when(inside, _bin(F.col("v"), b)).otherwise(place)
            counted = finite.select("v", which.alias("which"), place.alias("bin")).where("which is not null").groupBy("which", "bin").agg(
                F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
            ).collect()
            following: dict[int, Bracket] = {}
            for i, b in enumerate(todo):
                parts = [(r.lo, r.hi, r.n) for r in sorted(counted, key=lambda r: r.bin) if r.which == i]
                following |= _holding(parts, b.before, [p for p, x in brackets.items() if x == b])
            brackets = following
    return [known[p] for p in wanted]
