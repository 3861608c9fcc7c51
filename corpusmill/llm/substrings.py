"""Removal of long repeated passages through a run-length index.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

Parsing. Every such string has an anchor: the ``GRAM`` bytes in it with the smallest hash, leftmost first. Neighbouring strings
mostly have the same anchor; they form a phrase, the text from the first string's start to the last
one's end. Equal strings have equal anchors, so a string can only repeat among the phrases of one
anchor. As in prefix-free parsing, equal phrases are one entry of a dictionary, owned by the
smallest document that has it, and whatever holds for an entry holds wherever it occurs: within the
same stretch of input at once, else where an anchor's phrases meet (rows of hashes and places, no text).

Sides. A string reaches at least ``SIDE`` bytes beyond its anchor to the left or to the right. So two phrases of an anchor can only share a
string if the bytes of one of these sides, with the anchor, are equal in both. Hashes of both sides travel with a
phrase, and text is asked for only on a side on which phrases of different documents agree.

Indexing. Only such phrases need text. They are fetched and gathered
by anchor; a bounded lot of them is indexed by a run-compressed Burrows-Wheeler transform with the
suffix array sampled at run starts and ends. All phrases but the first of each anchor are streamed through
the index from their ends, which gives matching statistics: at each place the row and the length of the longest match.
Where that reaches ``LENGTH``, the index knows the smallest document among the rows with the same
string. An anchor with too many phrases for one lot is split by sides, and a side with too many by whole strings, which spreads it evenly.

Marking. Ranges of bytes meet their document once more, are merged, and the rest is hashed.
"""

from __future__ import annotations

import gc
import hashlib
import time
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, table
from corpusmill.session import ship_package

LENGTH = 50
GRAM = 16
#: Every string has so many bytes in front of its anchor, or so many behind it.
SIDE = (LENGTH - GRAM) // 2
#: Bytes parsed in one numpy pass (20 bits of position), and gathered before phrases are combined and handed on.
SLICE, GATHER = 1 << 20, 16 << 20
#: Different phrases of one anchor beyond which it is split by sides, and of one side beyond which it is by whole strings; symbols of one index.
WIDE, LOT = 2048, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# ---- parsing ---------------------------------------------------------------------------------------------------


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend((_powers(_BASE), _powers(_INVERSE), np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)))
    return _TABLES


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, phrase hash, start, length) of the phrases of texts that lie one after the other in ``data``.

    ``ends`` is the end of each text. At most SLICE bytes; no phrase crosses an end.
    """
    return sided_phrases(data, ends)[:4]


def sided_phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``phrases``, the place of the anchor in each, and hashes of the anchor with ``SIDE`` bytes before and after it (0: there are fewer)."""
    n = len(data)
    window = LENGTH - GRAM + 1
    last = n - LENGTH + 1  # possible starts
    if last <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint32, np.uint32))
    up, down, letter = _tables()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letter[data] * up[:n], out=sums[1:])
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    place = np.uint64((1 << 20) - 1)
    low = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size < window:  # minimum over windows, doubling
        more = min(size, window - size)
        low = np.minimum(low[: len(low) - more], low[more:])
        size += more
    anchor = (low & place).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    text_of = np.repeat(np.arange(len(ends)), sizes)[:last]
    good = np.arange(LENGTH, last + LENGTH) <= np.repeat(ends, sizes)[:last]
    new = np.ones(last, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text_of[1:] != text_of[:-1])
    start = np.flatnonzero(new & good)
    stop = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True)) + LENGTH
    whole = _mixed((sums[stop] - sums[start]) * down[start]) ^ (stop - start).astype(np.uint64)
    anchor = anchor[start]
    sides = []
    for a, b in ((anchor - SIDE, anchor + GRAM), (anchor, anchor + GRAM + SIDE)):
        inside = (a >= start) & (b <= stop)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        sides.append(np.where(inside, (_mixed((sums[b] - sums[a]) * down[a]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0)))
    return gram[anchor], _mixed(whole), start, stop - start, anchor - start, *sides


def _parse(parts: int):
    """Rows (part, key, phrase, doc, print, start, length, at, left, right, local) of arrays as bytes, for runs of documents."""
    names = ["part", "key", "phrase", "doc", "print", "start", "length", "at", "left", "right", "local"]
    types = [pa.int32(), *[pa.binary()] * 9, pa.bool_()]

    def emit(lot: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, phrase, doc, mark, start, length, at, left, right = (np.concatenate(c) for c in zip(*lot))
        # The smallest document of a phrase goes on to meet others; later ones are covered by it already.
        order = np.argsort(phrase)
        same = phrase[order[1:]] == phrase[order[:-1]]
        if (same & (key[order[1:]] != key[order[:-1]])).any():  # one hash for phrases of different anchors
            order = np.lexsort((key, phrase))
            same = (phrase[order[1:]] == phrase[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
        new = np.append(True, ~same)
        first = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = doc[order] > first
        none = np.empty(0, np.uint64)
        rows = []
        for local in (False, True):
            use = np.flatnonzero(later == local)
            cols = [c[use] for c in (key, phrase, doc, mark, start, length, at, left, right)]
            if local:  # runs of overlapping ranges of one document, as they were read, are one range
                reach = cols[4] + cols[5]
                fresh = np.ones(len(use), bool)
                fresh[1:] = (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1]) | (cols[4][1:] > reach[:-1]) | (cols[4][1:] < cols[4][:-1])
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(use))[: len(heads)] - 1
                cols = [none, none, *(c[heads] for c in cols[2:5]), (reach[tails] - cols[4][heads]), none, none, none]
                part = (_mixed(cols[2].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            else:
                part = (cols[0] >> np.uint64(32)).astype(np.int64) % parts
                cols[0] = cols[0].astype(np.uint32)
            o = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            bounds = np.flatnonzero(np.diff(part[o], prepend=-1))
            cols = [c[o] if len(c) == len(o) else c for c in cols]
            widths = [np.uint32, np.uint64, np.int64, np.uint32, np.uint32, np.int64 if local else np.uint8, np.uint8, np.uint32, np.uint32]
            for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(o)]):
                arrays = [(c[s:e] if len(c) == len(o) else c).astype(t).tobytes() for c, t in zip(cols, widths)]
                rows.append((int(part[o[s]]), *arrays, local))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held = [], 0
        texts: list[tuple[int, int, int, bytes]] = []  # document, print, start of the slice, bytes

        def flush() -> None:
            if not texts:
                return
            ends = np.cumsum([len(t[3]) for t in texts])
            key, phrase, start, length, *sides = sided_phrases(np.frombuffer(b"".join(t[3] for t in texts), np.uint8), ends)
            of = np.searchsorted(ends, start, side="right")
            doc, mark, base = (np.array([t[i] for t in texts], np.int64) for i in range(3))
            lot.append((key, phrase, doc[of], mark[of], start - (ends - [len(t[3]) for t in texts])[of] + base[of], length, *sides))
            texts.clear()

        room = SLICE
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                mark = zlib.crc32(data)
                at = 0
                while len(data) - at >= LENGTH:
                    if room < LENGTH or (room < SLICE and room < len(data) - at):
                        flush()
                        room = SLICE
                    part = data[at : at + room]
                    texts.append((doc.as_py(), mark, at, part))
                    room -= len(part)
                    held += len(part)
                    at = len(data) if at + len(part) == len(data) else at + len(part) - LENGTH + 1
                if held >= GATHER:
                    flush()
                    room, held = SLICE, 0
                    yield from emit(lot)
                    lot.clear()
        flush()
        if lot:
            yield from emit(lot)

    return run, (
        "part int, key binary, phrase binary, doc binary, print binary, start binary, length binary, at binary, left binary, right binary, local boolean"
    )


def _agreeing(side: np.ndarray, in_: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the groups ``in_``: does its side stand in entries of different owners, and in how many?"""
    asked, many = np.zeros(len(side), bool), np.zeros(len(side), np.int64)
    has = np.flatnonzero(side)
    if len(has):
        label = in_[has].astype(np.uint64) << np.uint64(32) | side[has]
        order = np.argsort(label)
        has, label = has[order], label[order]
        heads = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        low, high = np.minimum.reduceat(owner[has], heads), np.maximum.reduceat(owner[has], heads)
        count = np.diff(np.append(heads, len(has)))
        asked[has], many[has] = np.repeat(low < high, count), np.repeat(count, count)
    return asked, many


def _meet(wide: int):
    """All of one part together: ranges that are covered (``key`` null), and phrases whose text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "print", "start", "stop", "key", "wide"]
        kinds = [np.uint32, np.uint64, np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint32, np.uint32]

        def out(doc, mark, start, stop, key=None, split=None) -> pa.RecordBatch:
            none = [None] * len(doc)
            cols = [doc, mark.astype(np.int64), start, stop, none if key is None else key, none if split is None else split]
            types = [*[pa.int64()] * 5, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def settle(part: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            key, phrase, doc, mark, start, length, at, left, right = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((phrase, key))
            key, phrase, doc, mark, start, length, at, left, right = (c[order] for c in (key, phrase, doc, mark, start, length, at, left, right))
            start, at = start.astype(np.int64), at.astype(np.int64)
            stop, middle = start + length, start + at
            group = np.append(True, key[1:] != key[:-1])
            entry = group | np.append(True, phrase[1:] != phrase[:-1])
            of = np.cumsum(entry) - 1
            heads = np.flatnonzero(entry)
            owner = np.minimum.reduceat(doc, heads)
            first = doc == owner[of]
            yield out(*(c[~first] for c in (doc, mark, start, stop)))
            # Phrases of an anchor that agree on a side and are owned by different documents: these can share strings without being equal.
            in_ = np.cumsum(group)[heads] - 1
            (to_left, lefts), (to_right, rights) = (_agreeing(c[heads], in_, owner) for c in (left, right))
            broad = (np.bincount(in_[to_left | to_right], minlength=in_[-1] + 1) > wide)[in_]
            full = (np.int64(part) << np.int64(32)) | key.astype(np.int64)
            # Strings with a whole left side end behind the anchor by the rest of their length at most, and so on the right.
            from_, until = np.maximum(start, middle + GRAM + SIDE - LENGTH), np.minimum(stop, middle - SIDE + LENGTH)
            ask = np.flatnonzero(first & ((to_left | to_right) & ~broad)[of])
            yield out(
                doc[ask], mark[ask], np.where(to_left[of[ask]], start[ask], from_[ask]), np.where(to_right[of[ask]], stop[ask], until[ask]),
                full[ask], np.zeros(len(ask), bool),
            )
            for asked, many, side, begin, end, odd in ((to_left, lefts, left, start, until, 0), (to_right, rights, right, from_, stop, 1)):
                ask = np.flatnonzero(first & (asked & broad)[of])
                if len(ask):
                    own = _mixed(full[ask].view(np.uint64) * np.uint64(_BASE) + side[ask]) ^ np.uint64(odd)
                    yield out(doc[ask], mark[ask], begin[ask], end[ask], own.view(np.int64), (many > wide)[of[ask]])

        now, held = None, []
        for batch in batches:
            parts, locals_ = batch.column(0).to_pylist(), batch.column(10).to_pylist()
            for i, (part, local) in enumerate(zip(parts, locals_)):
                if local:
                    doc, mark, start, length = (np.frombuffer(batch.column(j)[i].as_py(), k) for j, k in zip(range(3, 7), (np.int64, np.uint32, np.uint32, np.int64)))
                    yield out(doc, mark, start.astype(np.int64), start + length)
                    continue
                arrays = [np.frombuffer(batch.column(1 + j)[i].as_py(), k) for j, k in enumerate(kinds)]
                if part != now and held:
                    yield from settle(now, held)
                    held = []
                now = part
                held.append(arrays)
        if held:
            yield from settle(now, held)

    return run


# ---- the run-length index --------------------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    padded = np.concatenate((data, np.zeros(7, np.uint8)))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts with owners.

    Symbols are bytes plus one, and zero ends each text. Kept are the runs (symbol, start, occurrences of the
    symbol before), suffix array samples at both ends of every run, and, for rows that share
    their first ``LENGTH`` symbols with a neighbour, the smallest owner among them.
    """

    def __init__(self, texts: list[bytes], owners: np.ndarray) -> None:
        size = np.array([len(t) + 1 for t in texts])
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum(size) - 1
        self.text = data.astype(np.int16) + 1
        self.text[ends] = 0
        n = len(self.text)
        self.words = _words(data)
        self.left = np.repeat(ends, size) - np.arange(n)  # symbols up to the end of the text
        rows, alike = self._suffixes()
        before = self.text[rows - 1]
        head = np.flatnonzero(np.diff(before, prepend=-1))
        self.run_start, self.run_symbol = head, before[head]
        tail = np.append(head[1:], n) - 1
        self.first_sample, self.last_sample = rows[head], rows[tail]
        lengths = tail - head + 1
        self.run_of = np.repeat(np.arange(len(head), dtype=np.int32), lengths)  # rank support: a row's run in one step
        order = np.argsort(self.run_symbol, kind="stable")
        # Where a run's first row goes in one step back: behind smaller symbols, and this one's runs above.
        self.run_rank = np.empty(len(head), np.int64)
        self.run_rank[order] = np.cumsum(lengths[order]) - lengths[order]
        # Runs of each symbol, to find the nearest ones: (symbol, run) in order.
        self.by_symbol = self.run_symbol[order].astype(np.int64) * (len(head) + 1) + order
        self.ordered_runs = order
        # Neighbouring rows whose first LENGTH symbols agree, and the smallest owner of each such class.
        self.class_start = np.flatnonzero(~alike)
        self.class_owner = np.minimum.reduceat(np.repeat(np.asarray(owners, np.int64), size)[rows], self.class_start)

    def _suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by doubling from seven symbols on; whether a row agrees with the one above in LENGTH symbols.

        Doubling ends with an order by more than LENGTH symbols. Suffixes that agree in that many are in any order: a
        step back from one of them leads to a row that agrees with the right one in as many symbols, and matches
        are counted up to LENGTH only.
        """
        n = len(self.text)
        padded = np.concatenate((self.text, np.zeros(7, np.int16))).astype(np.int64)
        key = np.zeros(n, np.int64)
        for k in range(7):
            key = key << 9 | padded[k : k + n]
        depth, half = 7, None
        while True:
            rows = np.argsort(key)
            new = np.diff(key[rows], prepend=-1) != 0
            rank = np.empty(n, np.int64)
            rank[rows] = np.cumsum(new) - 1
            if depth <= LENGTH <= 2 * depth:
                half = depth, rank
            if half is not None and (depth > LENGTH or new.all()):
                break
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - depth)] = rank[depth:] + 1
            key = rank * (n + 2) + follow
            depth *= 2
        depth, rank = half
        second = np.minimum(rows + LENGTH - depth, n - 1)
        alike = np.zeros(n, bool)
        alike[1:] = (rank[rows[1:]] == rank[rows[:-1]]) & (rank[second[1:]] == rank[second[:-1]])
        return rows, alike

    def _above_below(self, row: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest runs of ``symbol`` not below and below ``row``'s run; -1 where there is none."""
        run = self.run_of[row]
        width = len(self.run_start) + 1
        at = np.searchsorted(self.by_symbol, symbol.astype(np.int64) * width + run, side="right")
        above, below = at - 1, at
        has_above = (above >= 0) & (self.by_symbol[np.maximum(above, 0)] // width == symbol)
        last = len(self.by_symbol) - 1
        has_below = (below <= last) & (self.by_symbol[np.minimum(below, last)] // width == symbol)
        return (
            np.where(has_above, self.ordered_runs[np.maximum(above, 0)], -1),
            np.where(has_below, self.ordered_runs[np.minimum(below, last)], -1),
        )

    def _common(self, place: np.ndarray, words: np.ndarray, spot: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Length (LENGTH at most) of what the text has at ``place`` and a query, as ``words``, from ``spot`` on; ``left`` is its rest."""
        length, live = np.zeros(len(place), np.int64), np.arange(len(place))
        for k in range(0, LENGTH, 8):
            i = np.minimum(place[live] + k, len(self.words) - 1)
            differ = self.words[i] ^ words[np.minimum(spot[live] + k, len(words) - 1)]
            # Bytes before the first that differs: the zero bytes at the low end.
            length[live] += (np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3).astype(np.int64)
            live = live[differ == 0]
            if not len(live):
                break
        return np.minimum(np.minimum(length, LENGTH), np.minimum(self.left[place], left))

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of all texts at once, from their ends: (length, row) for each text and place.

        Lengths count up to LENGTH. Where the symbol before the current row is not the next one of the
        text, the walk moves to the nearest run of that symbol above or below, whichever matches longer
        by the samples at their ends.
        """
        width = max(map(len, texts))
        flat = np.frombuffer(b"".join(t.rjust(width, b"\0") for t in texts), np.uint8)  # to the right
        words = _words(flat)
        queries = flat.reshape(len(texts), width).astype(np.int16) + 1
        queries[np.arange(width) < width - np.array([len(t) for t in texts])[:, None]] = 0
        lengths, rows = np.zeros(queries.shape, np.int16), np.zeros(queries.shape, np.int64)
        row = np.zeros(len(texts), np.int64)  # any row: the empty match
        length = np.zeros(len(texts), np.int64)
        for at in range(width - 1, -1, -1):
            live = np.flatnonzero(queries[:, at] > 0)
            if not len(live):
                break
            symbol = queries[live, at].astype(np.int64)
            run = self.run_of[row[live]]
            hit = self.run_symbol[run] == symbol
            miss = np.flatnonzero(~hit)
            if len(miss):
                above, below = self._above_below(row[live[miss]], symbol[miss])
                best, to = np.full(len(miss), -1), np.zeros(len(miss), np.int64)
                for runs, samples, end in ((above, self.last_sample, True), (below, self.first_sample, False)):
                    has = np.flatnonzero(runs >= 0)
                    common = self._common(samples[runs[has]], words, live[miss[has]] * width + at + 1, width - at - 1)
                    better = common > best[has]
                    use = has[better]
                    best[use] = common[better]
                    edge = np.append(self.run_start[1:], len(self.text)) - 1 if end else self.run_start
                    to[use] = edge[runs[use]]
                lost = live[miss[best < 0]]
                row[live[miss]], length[live[miss]] = to, np.minimum(length[live[miss]], np.maximum(best, 0))
                length[lost] = -1  # the symbol is nowhere: start over behind it
                run = self.run_of[row[live]]
            step = self.run_rank[run] + row[live] - self.run_start[run]
            row[live] = np.where(length[live] < 0, 0, step)
            length[live] = np.minimum(length[live] + 1, LENGTH)
            lengths[live, at], rows[live, at] = length[live], row[live]
        return lengths, rows

    def smallest_owner(self, rows: np.ndarray) -> np.ndarray:
        return self.class_owner[np.searchsorted(self.class_start, rows, side="right") - 1]


def repeated_starts(texts: list[bytes], groups: np.ndarray, owners: np.ndarray) -> list[np.ndarray]:
    """For each phrase, the places where a string starts that a phrase of its group with a smaller owner has too.

    The phrases of a group but those of its largest owner are indexed, all but those of its smallest streamed.
    """
    low, high = {}, {}
    for g, o in zip(groups.tolist(), owners.tolist()):
        low[g], high[g] = min(o, low.get(g, o)), max(o, high.get(g, o))
    source: dict[bytes, int] = {}
    for t, g, o in zip(texts, groups.tolist(), owners.tolist()):
        if o < high[g]:
            source[t] = min(o, source.get(t, o))
    asked = [i for i, (g, o) in enumerate(zip(groups.tolist(), owners.tolist())) if o > low[g]]
    out = [np.empty(0, np.int64)] * len(texts)
    if not source or not asked:
        return out
    index = RunIndex(list(source), np.fromiter(source.values(), np.int64))
    for at in range(0, len(asked), 16384):
        part = asked[at : at + 16384]
        lengths, rows = index.stream([texts[i] for i in part])
        which, there = np.nonzero(lengths >= LENGTH)
        covered = index.smallest_owner(rows[which, there]) < owners[part][which]
        which, there = which[covered], there[covered]
        bounds = np.searchsorted(which, np.arange(len(part) + 1))
        for k in np.unique(which).tolist():
            pad = lengths.shape[1] - len(texts[part[k]])
            out[part[k]] = there[bounds[k] : bounds[k + 1]] - pad
    return out


def _index(lot: int):
    """Rows (key, doc, print, start, text) in the order of keys: ranges of bytes that are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            key, doc, mark, start, text = zip(*held)
            found = repeated_starts(list(text), np.array(key), np.array(doc, np.int64))
            out = []
            for d, m, s, there in zip(doc, mark, start, found):
                if len(there):
                    gap = np.flatnonzero(np.diff(there) > LENGTH)
                    for a, b in zip(there[np.append(0, gap + 1)].tolist(), there[np.append(gap, len(there) - 1)].tolist()):
                        out.append((d, m, s + a, s + b + LENGTH))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc", "print", "start", "stop"])

        held, symbols = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if symbols >= lot and row[0] != held[-1][0]:
                    yield from settle(held)
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[4]) + 1
        if held:
            yield from settle(held)

    return run


# ---- the operator ----------------------------------------------------------------------------------------------


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.crc32(text.cast("binary")).alias("print"))


def _parsed(rows: DataFrame, partitions: int, wide: int) -> DataFrame:
    run, schema = _parse(16 * partitions)
    made = rows.where("doc is not null").select("doc", "text").mapInArrow(run, schema)
    met = made.repartition(partitions, "part").sortWithinPartitions("part")
    return stored(met.mapInArrow(_meet(wide), "doc long, print long, start long, stop long, key long, wide boolean"))


def _indexed(rows: DataFrame, parsed: DataFrame, partitions: int, lot: int) -> DataFrame:
    """Ranges found by the index. Every document's wishes are bounded by its own length."""
    asked = parsed.where("key is not null").groupBy("doc", "print").agg(
        F.collect_list(F.struct("start", "stop", "key", "wide")).alias("asked")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            asks, sizes = batch.column(3), pc.list_value_length(batch.column(3)).to_pylist()
            wishes = zip(*(c.to_pylist() for c in asks.flatten().flatten()))
            for doc, mark, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), sizes):
                data = text.as_py().encode()
                for start, stop, key, split in islice(wishes, n):
                    if not split:
                        out.append((key, doc, mark, start, data[start:stop]))
                        continue
                    for s in range(start, stop - LENGTH + 1):  # each string by itself
                        string = data[s : s + LENGTH]
                        own = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                        out.append((own, doc, mark, s, string))
            if out:
                types = [*[pa.int64()] * 4, pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc", "print", "start", "text"])

    fetched = rows.join(asked, ["doc", "print"]).select("doc", "print", "text", "asked").mapInArrow(
        cut, "key long, doc long, print long, start long, text binary"
    )
    gathered = fetched.repartition(partitions, "key").sortWithinPartitions("key")
    return stored(gathered.mapInArrow(_index(lot), "doc long, print long, start long, stop long"))


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are stored.

    It does so when the driver's JVM finds nothing that refers to them; Python's references to its
    objects are given up by a thread of their own, shortly after they go here.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.4)
        spark._jvm.System.gc()


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, wide: int = WIDE, lot: int = LOT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the kept bytes (``kept``, or ``kept_sha256``).

    A null text is empty. Texts shorter than ``LENGTH`` bytes keep everything. Rows with a null id neither
    lose bytes nor cost others any. Rows that repeat an id are no smaller than each other, so they keep
    what only they share; with equal texts they get equal rows. Other columns are not looked at; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _texts(docs, id_col, text_col)
    parsed = _parsed(rows, partitions, wide)
    _release(spark)
    indexed = _indexed(rows, parsed, partitions, lot)
    _release(spark)
    ranges = (
        parsed.where("key is null").select("doc", "print", "start", "stop").unionByName(indexed)
        .groupBy("doc", "print").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
        .select(F.col("doc").alias("_doc"), F.col("print").alias("_print"), "ranges")
    )
    joined = rows.join(ranges, (F.col("doc") == F.col("_doc")) & (F.col("print") == F.col("_print")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"]
        for batch in batches:
            out = []
            for doc, text, ranges in zip(*(batch.column(i) for i in range(3))):
                data = text.as_py().encode()
                removed, spans, at, kept = 0, 0, 0, []
                if ranges.is_valid:
                    flat = ranges.values.flatten()
                    pairs = np.stack([c.to_numpy() for c in flat], axis=1)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    fresh = np.append(True, pairs[1:, 0] > reach[:-1])
                    heads = np.flatnonzero(fresh)
                    for s, e in zip(pairs[heads, 0].tolist(), reach[np.append(heads[1:], len(pairs)) - 1].tolist()):
                        kept.append(data[at:s])
                        removed, spans, at = removed + e - s, spans + 1, e
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((doc.as_py(), len(data), removed, spans, hashlib.sha256(rest).hexdigest() if digests else rest))
            types = [*[pa.int64()] * 4, pa.string() if digests else pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    last = "kept_sha256 string" if digests else "kept binary"
    return joined.select("doc", "text", "ranges").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digests=True)
