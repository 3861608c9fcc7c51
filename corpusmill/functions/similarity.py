"""Near-duplicate rule: native Jaccard on character shingles, and the Python tail of the rule.

The last step of the rule is a longest-matching-block ratio, for which Spark has no built-in that
gives the same value (edit distance does not). Only that step, and the order-dependent greedy pass
around it, run in Python, on short per-group lists.
"""

from __future__ import annotations

from collections import Counter, deque
from difflib import SequenceMatcher
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corpusmill import fixed


def shingles(col: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text without blanks; a shorter text is its own shingle."""
    packed = F.replace(col, F.lit(" "), F.lit(""))
    # A look-ahead matches at every position: overlapping grams in one linear pass.
    grams = F.regexp_extract_all(packed, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1))
    return F.when(F.length(packed) < n, F.array(packed)).otherwise(F.array_distinct(grams))


def set_jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b)).cast("double")
    return common / (F.size(a) + F.size(b) - common)


def jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Shingle Jaccard of two normalised texts: 1 if equal, 0 if either is empty."""
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(set_jaccard(shingles(a, n), shingles(b, n)))
    )


def length_compatible(a: Column, b: Column) -> Column:
    """Texts whose lengths differ by more than 40 % are never duplicates."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return low.cast("double") / high >= F.lit(fixed.DEDUP_LENGTH_RATIO)


def _reaches(matcher: SequenceMatcher, la: int, lb: int, threshold: float) -> bool:
    """Whether the matching-block ratio of the two texts is at least ``threshold``.

    Splits at longest common blocks, largest open range first, and stops as soon as the open ranges
    cannot supply the missing matches (or the matches found already suffice). Unrelated texts are
    settled by their first block, because it sits at different places in the two.
    """
    total = la + lb
    matched, open_ranges, supply = 0, [(-min(la, lb), 0, la, 0, lb)], min(la, lb)
    while open_ranges and 2.0 * (matched + supply) / total >= threshold:
        if 2.0 * matched / total >= threshold:
            return True
        bound, alo, ahi, blo, bhi = heappop(open_ranges)
        supply += bound
        i, j, size = matcher.find_longest_match(alo, ahi, blo, bhi)
        if size:
            matched += size
            for rest in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                room = min(rest[1] - rest[0], rest[3] - rest[2])
                if room > 0:
                    supply += room
                    heappush(open_ranges, (-room, *rest))
    return 2.0 * matched / total >= threshold


#: Bins of hashed grams, as bits.
BIN_BITS = 14
#: Characters of two texts below which the rule itself costs no more than its bounds.
BOUNDED_CHARS = 200


def _bins(hashed: np.ndarray) -> np.ndarray:
    return ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


class _Text:
    """A normalised text with the derived forms the pair rule looks at, built on first use."""

    def __init__(self, text: str):
        self.text = text
        self.length = len(text)

    @cached_property
    def letters(self) -> Counter:
        return Counter(self.text)

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64)

    @cached_property
    def hashed_fives(self) -> np.ndarray:
        count = max(0, len(self.codes) - 4)
        hashed = np.zeros(count, np.uint64)
        for shift in range(5):
            hashed = hashed * np.uint64(1_000_003) + self.codes[shift : shift + count]
        return hashed

    @cached_property
    def fives(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashed 5-grams and their counts."""
        return np.unique(self.hashed_fives, return_counts=True)

    @cached_property
    def five_bins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins of the 5-grams that are not empty, their counts, and the counts of all bins."""
        bins = np.sort(_bins(self.hashed_fives))
        heads = np.flatnonzero(np.append(True, bins[1:] != bins[:-1])[: len(bins)])
        counts = np.append(heads[1:], len(bins))[: len(heads)] - heads
        some, counts = bins[heads], counts.astype(np.int32 if self.length >> 16 else np.uint16)
        every = np.zeros(1 << BIN_BITS, counts.dtype)
        every[some] = counts
        return some, counts, every

    @cached_property
    def grams(self) -> np.ndarray:
        """Distinct 3-grams of the text without blanks, 21 bits a letter, in order; a shorter text is its own shingle."""
        codes = self.codes[self.codes != 32]
        if len(codes) < 3:
            return np.array([sum(int(c) << 21 * i for i, c in enumerate(codes)) | 4 + len(codes) << 61], np.uint64)
        grams = np.sort(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])
        return grams[np.append(True, grams[1:] != grams[:-1])]

    @cached_property
    def gram_bins(self) -> int:
        """A number with a bit for each bin of the 3-grams."""
        seen = np.zeros(1 << BIN_BITS, np.uint8)
        seen[_bins(self.grams)] = 1
        return int.from_bytes(np.packbits(seen).tobytes(), "little")

    @cached_property
    def matcher(self) -> SequenceMatcher:
        return SequenceMatcher(None, "", self.text)


def _common_fives(a: _Text, b: _Text) -> int:
    grams, counts = a.fives
    others, other_counts = b.fives
    _, left, right = np.intersect1d(grams, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[left], other_counts[right]).sum())


def _shingles_differ(earlier: _Text, new: _Text) -> bool:
    """Whether bins alone show that the Jaccard of the 3-grams is too low: a bin that only one text has stands for a gram that the other lacks."""
    only, lacks = (new.gram_bins & ~earlier.gram_bins).bit_count(), (earlier.gram_bins & ~new.gram_bins).bit_count()
    common = min(len(new.grams) - only, len(earlier.grams) - lacks)
    return common <= 0 or common / (common + only + lacks) < fixed.DEDUP_JACCARD


def _few_common_fives(earlier: _Text, new: _Text, threshold: float) -> bool:
    """Whether 5-grams, counted by bin, already show what ``_near`` asks of those in common."""
    bins, counts, _ = new.five_bins
    common, total = int(np.minimum(counts, earlier.five_bins[2][bins]).sum()), earlier.length + new.length
    return 2.0 * (common + 4 * (total + 1)) / 9 / total < threshold


def _near(earlier: _Text, new: _Text, threshold: float) -> bool:
    low, high = sorted((earlier.length, new.length))
    if low / high < fixed.DEDUP_LENGTH_RATIO:
        return False
    bounded = low + high >= BOUNDED_CHARS
    if not (bounded and _shingles_differ(earlier, new)):
        common = len(np.intersect1d(new.grams, earlier.grams, assume_unique=True))
        if common / (len(new.grams) + len(earlier.grams) - common) >= fixed.DEDUP_JACCARD:
            return True
    if bounded and _few_common_fives(earlier, new, threshold):
        return False
    # Letters in common bound the matched characters from above.
    shared = sum((earlier.letters & new.letters).values())
    if 2.0 * shared / (low + high) < threshold:
        return False
    # A run of matches loses at most four 5-grams, and each run but one follows an unmatched letter,
    # so m matched letters need at least m - 4 x (unmatched + 1) common 5-grams: this bounds m.
    total = low + high
    if 2.0 * (_common_fives(earlier, new) + 4 * (total + 1)) / 9 / total < threshold:
        return False
    new.matcher.set_seq1(earlier.text)
    return _reaches(new.matcher, earlier.length, new.length, threshold)


class RecentTexts:
    """The most recently kept texts, and the question whether a new text repeats one of them."""

    def __init__(self, gate: int, threshold: float = fixed.DEDUP_THRESHOLD, texts=()):
        self.gate = gate
        self.threshold = threshold
        self.kept: deque[_Text] = deque((_Text(t) for t in texts), maxlen=fixed.DEDUP_LOOK_BACK)

    def texts(self) -> list[str]:
        return [t.text for t in self.kept]

    def keep_if_new(self, text: str) -> bool:
        """Remember the text and return True, unless it repeats a recent one."""
        new = _Text(text)
        for earlier in self.kept:
            if earlier.text == text:
                return False
            if abs(earlier.length - new.length) <= self.gate and _near(earlier, new, self.threshold):
                return False
        self.kept.append(new)
        return True


def greedy_positions(norms, gate: int, exact_only: bool = False) -> list[int]:
    """Positions kept by the greedy pass over normalised texts (empty ones are dropped)."""
    seen: set[str] = set()
    recent = RecentTexts(gate)
    kept = []
    for position, text in enumerate(norms):
        if text and text not in seen and (exact_only or recent.keep_if_new(text)):
            seen.add(text)
            kept.append(position)
    return kept


# Both are declared non-deterministic although they are not: it keeps the optimiser from copying the
# Python call into lambda bodies and inferred filters, where it cannot be evaluated.
def kept_positions(gate: int, exact_only: bool = False):
    """Pandas UDF: array of normalised texts -> array of kept positions (from 0)."""

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def run(norms: pd.Series) -> pd.Series:
        return norms.map(lambda xs: greedy_positions(xs, gate, exact_only) if xs is not None else [])

    return run.asNondeterministic()


def kept_positions_nested(gate: int, exact_only: bool = False):
    """Pandas UDF: the same for an array of lists, each list on its own."""

    @pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(groups: pd.Series) -> pd.Series:
        return groups.map(
            lambda gs: [greedy_positions(g, gate, exact_only) for g in gs] if gs is not None else []
        )

    return run.asNondeterministic()


@pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 x matched characters / total characters, from longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def is_duplicate(a: Column, b: Column, threshold: float = fixed.DEDUP_THRESHOLD) -> Column:
    """The whole pair rule on two normalised texts."""
    cheap = (a == b) | (jaccard(a, b) >= F.lit(fixed.DEDUP_JACCARD))
    return (a != "") & (b != "") & ((a == b) | (length_compatible(a, b) & (cheap | (matching_ratio(a, b) >= threshold))))
