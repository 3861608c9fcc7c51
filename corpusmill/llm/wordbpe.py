"""Encoding and decoding with a word-end byte-pair vocabulary through a minimal acyclic transducer.

The corpus's most frequent words are compiled, with the ids that the merges give them, into a minimal
acyclic automaton: equal suffixes are one path, and the number of words skipped on the way to a
word is its place in a table of id outputs. The automaton is a few flat arrays in one file, which
each worker maps into memory; a batch's distinct words are looked up in it all at once, one byte per
step. Words that are not in it are merged exactly, by the vocabulary's merge ranks. Whether a word is
in the lexicon changes the time it takes, never the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.files import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, table
from corpusmill.session import ensure_checkpoint_dir, ship_package

#: Frequent words in the lexicon. They are the top of counts over all words of all texts.
LEXICON = 1 << 16
#: Words longer than this (in bytes) are merged, not compiled or remembered.
LONGEST = 64
#: Distinct words that a worker counts or remembers before it hands them on or forgets them.
HELD = 200_000
#: Characters of text whose new words are looked up and merged together.
TOGETHER = 1 << 21
NEVER = 1 << 30
_FIELDS = ("first", "label", "target", "skip", "final", "start", "ids")


# ---- the vocabulary --------------------------------------------------------------------------------------------


class Vocabulary:
    """The parts of a tokenizers file: normalisation, splitting, merges, added tokens."""

    def __init__(self, path: str) -> None:
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.suffix: str = model["end_of_word_suffix"]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = (self.ids[a], self.ids[b])
            self.ranks.setdefault(key, (rank, self.ids[a + b]))
        # GPT-style byte alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = itertools.count(256)
        self.letter = [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.ranks.items())
        self.pair, self.pair_rank, self.pair_new = (np.array(c, np.int64) for c in zip(*pairs))
        self.inner, self.last = (np.array([self.ids.get(c + end, -1) for c in self.letter]) for end in ("", self.suffix))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # \s of the file means the White_Space property, in which Python's own \s differs.
        self.split = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}").replace(r"[\s", r"[\p{White_Space}"))
        # The same for lower-cased ASCII texts, where the standard library is faster.
        self.plain = re.compile(split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.id_text = [str(i) for i in range(max(self.tokens) + 1)]
        self.token_text = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]

    def words(self, text: str) -> list[str]:
        """Words of a text without added tokens, normalised. White space only separates, so it needs no folding."""
        if text.isascii():
            return self.plain.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # one character at a time: a capital sigma at a word's end is not special
            text = "".join(c.lower() for c in text)
        return self.split.findall(text.lower())

    def pieces(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """(words, added token after them)."""
        parts = self.special.split(text) if self.special else [text]
        for i in range(0, len(parts), 2):
            yield self.words(parts[i]), parts[i + 1] if i + 1 < len(parts) else None

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the merge of lowest rank first, the leftmost of equal ones."""
        marks = [self.letter[b] for b in word.encode()]
        marks[-1] += self.suffix
        ids = [self.ids[m] for m in marks if m in self.ids]
        ranks = self.ranks
        if len(ids) <= LONGEST:
            while len(ids) > 1:
                found = min(((*ranks[p], i) for i, p in enumerate(itertools.pairwise(ids)) if p in ranks), default=None)
                if found is None:
                    break
                rank, new, at = found[0], found[1], found[2]
                ids[at : at + 2] = [new]
            return ids
        # Long words: a heap of pairs over a linked list.
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(*ranks[p], i, *p) for i, p in enumerate(itertools.pairwise(ids)) if p in ranks]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (pair := (ids[x], ids[y])) in ranks:
                    rank, made = ranks[pair]
                    heapq.heappush(heap, (rank, x, made, *pair))
        return [i for i in ids if i >= 0]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new id of pairs; rank NEVER for pairs that do not merge."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[at] == want, self.pair_rank[at], NEVER), self.pair_new[at]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of many words: in each round every word makes its next merge, all words in one numpy pass."""
        out: list[list[int]] = [[] for _ in words]
        data = [w.encode() for w in words]
        short = []
        for i, d in enumerate(data):
            if len(d) > LONGEST:
                out[i] = self.merge(words[i])
            else:
                short.append(i)
        data = [data[i] for i in short]
        if not data:
            return out
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        ids, stop = self.inner[flat], np.cumsum(size) - 1
        ids[stop] = self.last[flat[stop]]
        word = np.repeat(np.arange(len(data)), size)
        word, ids = word[ids >= 0], ids[ids >= 0]
        rank, new = np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)
        here = np.flatnonzero(word[1:] == word[:-1])
        rank[here], new[here] = self._ranked(ids[here], ids[here + 1])
        while len(ids):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), heads)
            more = best >> 32 < NEVER
            sizes = np.diff(heads, append=len(ids))
            if not more.all():  # words without a merge are done
                going = np.repeat(more, sizes)
                starts = heads[~more]
                for w, s, n in zip(word[starts].tolist(), starts.tolist(), sizes[~more].tolist()):
                    out[short[w]] = ids[s : s + n].tolist()
                moved = np.cumsum(going) - 1
                best = moved[best[more] & 0xFFFFFFFF]
                ids, word, rank, new = ids[going], word[going], rank[going], new[going]
            else:
                best = best & 0xFFFFFFFF
            if not len(ids):
                break
            ids[best] = new[best]
            stay = np.ones(len(ids), bool)
            stay[best + 1] = False
            ids, word, rank, new = ids[stay], word[stay], rank[stay], new[stay]
            best = best - np.arange(len(best))
            rank[best] = NEVER
            for left in (best - 1, best):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[word[left] == word[left + 1]]
                rank[left], new[left] = self._ranked(ids[left], ids[left + 1])
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# ---- the transducer --------------------------------------------------------------------------------------------


def compile_words(words: Iterable[tuple[bytes, list[int]]]) -> np.ndarray:
    """Minimal acyclic automaton of distinct byte strings with their ids, as one array of 32-bit numbers.

    Words are added in sorted order; what the next word cannot share any more is folded onto an equal
    state made before, so equal suffixes are stored once.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # (final, ((byte, state), ...)), targets before sources
    path: list[list] = [[False, []]]  # open states of the last word: final, closed transitions

    def close(down_to: int, last: bytes) -> None:
        while len(path) - 1 > down_to:
            final, moves = path.pop()
            key = (final, tuple(moves))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], register[key]))

    last, outputs = b"", []
    for word, ids in sorted(words):
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared, last)
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        outputs.append(ids)
        last = word
    close(0, last)
    states.append((path[0][0], tuple(path[0][1])))

    below = []  # words at or below a state
    first, label, target, skip = [0], [], [], []
    for final, moves in states:
        seen = int(final)
        for byte, to in moves:
            label.append(byte)
            target.append(to)
            skip.append(seen)
            seen += below[to]
        below.append(seen)
        first.append(len(label))
    start = np.cumsum([0, *map(len, outputs)])
    arrays = [first, label, target, skip, [f for f, _ in states], start, list(itertools.chain.from_iterable(outputs))]
    flat = [np.asarray(a, np.int32) for a in arrays]
    return np.concatenate([np.array([len(a) for a in flat], np.int32), *flat])


class Lexicon:
    """Look-up in a compiled automaton, which may be a file mapped into memory."""

    def __init__(self, data: np.ndarray) -> None:
        at = len(_FIELDS)
        for name, size in zip(_FIELDS, data[: len(_FIELDS)].tolist()):
            setattr(self, name, data[at : at + size])
            at += size
        self.root = len(self.final) - 1
        # Transitions are in the order of (state, byte): one number to search for.
        owner = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first))
        self.key = owner << 8 | self.label

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words take their n-th byte in the same step."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.key):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        alive = np.flatnonzero((size > 0) & (size <= LONGEST))
        state, number = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64)
        step = 0
        while len(alive):
            want = state << 8 | flat[start[alive] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            alive, at = alive[hit], at[hit]
            number = number[hit] + self.skip[at]
            state = self.target[at].astype(np.int64)
            step += 1
            done = size[alive] == step
            good = done & (self.final[state] == 1)
            out[alive[good]] = number[good]
            alive, state, number = alive[~done], state[~done], number[~done]
        return out

    def output(self, number: int) -> list[int]:
        return self.ids[self.start[number] : self.start[number + 1]].tolist()


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", top: int = LEXICON) -> list[str]:
    """The most frequent words of all texts, ``top`` at most: those from some frequency on, however many share it.

    Words are counted in every task before the counts are summed; words seen once are never frequent.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = vocabulary(path), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for words, _ in vocab.pieces(text.as_py() or ""):
                    seen.update(words)
                if len(seen) > HELD:
                    yield flush()
        yield flush()

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "w string, n long")
    counts = counts.where(F.octet_length("w") <= LONGEST).groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    # Sixteen steps to a doubling: a bounded histogram tells from which step on the words fit the lexicon.
    words = stored(counts.select("w", F.floor(F.log2("n") * 16).cast("int").alias("step")))
    fit, least = 0, None
    for r in words.groupBy("step").count().orderBy(F.desc("step")).collect():
        if fit + r["count"] > top:
            break
        fit, least = fit + r["count"], r.step
    return [] if least is None else [r.w for r in words.where(F.col("step") >= least).collect()]


def ship_lexicon(spark: SparkSession, data: np.ndarray) -> str:
    """Put the automaton into the shared folder; Spark copies it to every executor that needs it. Returns its name."""
    import io

    name = f"lexicon-{uuid.uuid4().hex}.npy"
    target = f"{ensure_checkpoint_dir(spark)}/{name}"
    buffer = io.BytesIO()
    np.save(buffer, data)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(buffer.getvalue())
    out.close()
    fs.deleteOnExit(path)
    spark.sparkContext.addFile(target)
    return name


@cache
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


# ---- texts -----------------------------------------------------------------------------------------------------


class Coder:
    """Encodes and decodes texts; remembers distinct words within a bound."""

    def __init__(self, path: str, lexicon: Lexicon) -> None:
        self.vocab, self.lexicon = vocabulary(path), lexicon
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Make sure that all of ``words`` are known; what is not asked for may be forgotten."""
        new = list(words - self.ids.keys())
        if len(self.ids) + len(new) > HELD:
            self.ids.clear()
            self.tokens.clear()
            new = list(words)
        place = self.lexicon.find([w.encode() for w in new]).tolist()
        unseen = [w for w, at in zip(new, place) if at < 0]
        seen = [w for w, at in zip(new, place) if at >= 0]
        made = [*(self.lexicon.output(at) for at in place if at >= 0), *self.vocab.merge_all(unseen)]
        number, token = self.vocab.id_text, self.vocab.token_text
        new = seen + unseen
        self.ids.update(zip(new, [" ".join([number[i] for i in ids]) for ids in made]))
        self.tokens.update(zip(new, [" ".join([token[i] for i in ids]) for ids in made]))

    def code(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by spaces, tokens joined by spaces) of whole texts, whose words are learned together."""
        split = [list(self.vocab.pieces(t or "")) for t in texts]
        self.learn({w for pieces in split for words, _ in pieces for w in words})
        out = []
        for pieces in split:
            ids, tokens = [], []
            for words, added in pieces:
                if words:
                    ids.append(" ".join(map(self.ids.__getitem__, words)))
                    tokens.append(" ".join(map(self.tokens.__getitem__, words)))
                if added is not None:
                    ids.append(str(self.vocab.added[added]))
                    tokens.append(added)
            joined = " ".join(ids)
            out.append((joined.count(" ") + 1 if ids else 0, joined, " ".join(tokens)))
        return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every row; with ``digests`` SHA-256 of the last two instead.

    Ids are what the tokenizers library gives without its own special tokens; added tokens that stand
    in a text become their ids. A null or empty text has no ids. Every row is coded by itself, so
    repeated rows and null ids need no rule; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocab = vocabulary(path)
    name = ship_lexicon(spark, compile_words((w.encode(), vocab.merge(w)) for w in frequent_words(docs, path, text_col)))

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, _mapped(name))
        for batch in batches:
            made, texts, held = [], [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= TOGETHER or i == batch.num_rows - 1:
                    for n, ids, decoded in coder.code(texts):
                        made.append((n, digest(ids), digest(decoded)) if digests else (n, ids, decoded))
                    texts, held = [], 0
            n, ids, decoded = zip(*made) if made else ((), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
