import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from corpusmill.llm import wordbpe as W
from tests.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)

ODD = [
    None, "", " ", "Hello World's 123", "it'S WE'LL", "<|startoftext|>Hi<|endoftext|>", "<|endoftext|><|endoftext|>", "a" * 5000,
    "ΟΔΟΣ Σ ΑΣ. İstanbul ǅ ß ẞ", "é ñ", "\x1c\x1d a\x85b c d​", "🙂👩‍👩‍👧 ñ", "١٢٣ ⅷ ² ½", "_x_ -- ...!!", "\x00\x01",
    "日本語 한국어 عربى", "don't 'twas 're", "x" * 200 + " " + "ab" * 150,
]


def plain(text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), TOK.decode(ids, skip_special_tokens=False)


def test_odd_texts_with_and_without_lexicon():
    vocab = W.vocabulary(PATH)
    words = ["hello", "world", "it", "a", "ab", "abc", "bc", "c", "zebra"]
    full = W.Lexicon(W.compile_words((w.encode(), vocab.merge(w)) for w in words))
    empty = W.Lexicon(W.compile_words([]))
    for text in ODD:
        assert W.Coder(PATH, full).code([text]) == [plain(text)], text
        assert W.Coder(PATH, empty).code([text]) == [plain(text)], text


def test_random_strings():
    rng = random.Random(3)
    alphabet = [*"abcdefgh'SstT  \n\t.,!?123", "é", "é", "ß", "Σ", "σ", "日", "‍", "🙂", "\x1f", "\x85", "　", "ª", "²"]
    coder = W.Coder(PATH, W.Lexicon(W.compile_words([])))
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(25)]
        for text, made in zip(texts, coder.code(texts)):
            assert made == plain(text), repr(text)


def test_all_words_at_once_as_one_by_one():
    rng = random.Random(6)
    vocab = W.vocabulary(PATH)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 90))) for _ in range(400)] + ["é", "aaaa", "日本"]
    assert vocab.merge_all(words) == [vocab.merge(w) for w in words]
    assert vocab.merge_all([]) == []


def test_automaton_is_exact_and_shares_suffixes():
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(3000)}
    held = dict(zip(sorted(words), range(len(words))))
    data = W.compile_words((w.encode(), [i, i + 1][: 1 + i % 2]) for w, i in held.items())
    lex = W.Lexicon(data)
    asked = [*words, *("".join(rng.choice("abéc") for _ in range(rng.randrange(0, 9))) for _ in range(3000)), "x" * 100]
    for word, at in zip(asked, lex.find([w.encode() for w in asked]).tolist()):
        assert (at >= 0) == (word in held)
        if at >= 0:
            i = held[word]
            assert lex.output(at) == [i, i + 1][: 1 + i % 2]
    assert len(lex.final) < len({w.encode()[:k] for w in words for k in range(len(w.encode()) + 1)}) / 2


def test_bound_on_remembered_words(monkeypatch):
    monkeypatch.setattr(W, "HELD", 5)
    coder = W.Coder(PATH, W.Lexicon(W.compile_words([])))
    for k in range(6):
        text = f"one two three{k} four"
        assert coder.code([text]) == [plain(text)] and len(coder.ids) <= 5


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = W.op7_word_bpe(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        n, ids, decoded = plain(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        )


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in W.encode(df, PATH).collect()) == [(0, 2, "a</w> b</w>"), (1, 0, ""), (1, 0, "")]
    assert W.encode(df.limit(0), PATH).count() == 0


def test_frequent_words(spark):
    df = spark.createDataFrame([("a a a b b c",), ("A d d d",), (None,)], "text string")
    assert sorted(W.frequent_words(df, PATH)) == ["a", "b", "d"]
    assert W.frequent_words(df, PATH, top=1) == ["a"]
    assert W.frequent_words(df.limit(0), PATH) == []
