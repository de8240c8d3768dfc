import hashlib
import random
from pathlib import Path

import pytest

from folio.llm import bpe, tokencount
from folio.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, n_tokens string, ids string"
TEXTS = [None, "", " ", "Hello world, it's 2024!", "don't  \n\n x\t", "日本語 émigré 😀😀", "a" * 5000, "<|endoftext|> ⁇ \x00\x1c\x85", "word " * 4000, "Hello world, it's 2024!"]


@pytest.fixture(scope="module")
def codec():
    path, pattern = vocabulary()
    return bpe.Codec(bpe.load_ranks(path), pattern)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def test_ids_are_those_of_the_library(codec, reference):
    r = random.Random(2)
    texts = [t for t in TEXTS if t] + ["".join(chr(r.choice((r.randint(32, 126), r.randint(160, 1500), r.randint(0x4E00, 0x4F00), 10, 32))) for _ in range(200)) for _ in range(200)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_small_caches_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 7)
    path, pattern = vocabulary()
    c = bpe.Codec(bpe.load_ranks(path), pattern)
    text = " ".join(f"word{k} other{k % 5}" for k in range(300))
    assert c.encode(text) == reference.encode_ordinary(text)


def test_long_texts_after_others(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(bpe, "PORTION", 16, raising=False)
    path, pattern = vocabulary()
    c = bpe.Codec(bpe.load_ranks(path), pattern)
    long = [" ".join(f"word{k} xq{k}zj other{k % 5}" for k in range(at, at + 300)) for at in (0, 100, 200)]
    for text in ("word1 other2", long[0], long[1], "word1 other2 xq1zj", long[2], long[0]):
        assert c.encode(text) == reference.encode_ordinary(text)
        assert len(c.known) <= 50


def test_sparse_ranks():
    ranks = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 900, b"abc": 800}
    c = bpe.Codec(ranks, r"\S+|\s+")
    assert c.encode("abc xabx") == [800, 64, 240, 900, 240] and c.decode([800, 64]) == b"abc "


def test_operators(spark, reference):
    docs = frame(spark)
    ids = {r.doc_id: list(r.ids) for r in bpe.encode(docs, *vocabulary()).collect()}
    assert ids == {i: reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, *vocabulary()), *vocabulary()).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in bpe.round_trip(docs, *vocabulary()).collect():
        assert r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), *vocabulary()).count() == 0
    assert bpe.round_trip(spark.createDataFrame([(None, "x")], "doc_id long, text string"), *vocabulary()).first().doc_id is None


def slow(word, entries, mark=tokencount.MARK):
    text, at, n = mark + word, 0, 0
    while at < len(text):
        end = next((j for j in range(len(text), at, -1) if text[at:j] in entries and text[at:j].startswith(mark) == (at == 0)), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_counts_greedy_pieces():
    r = random.Random(1)
    for _ in range(1500):
        entries = {("▁" if r.random() < 0.4 else "") + "".join(r.choice("abc") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 14))} - {""}
        a = tokencount.Automaton(sorted(entries))
        for _ in range(6):
            w = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 12)))
            assert a.pieces(w) == slow(w, entries), (w, entries)
    assert tokencount.Automaton([]).pieces("a") is None


def test_counts(spark):
    path = vocabulary("piece_bpe_32k.model")[0]
    pieces = tokencount.entries_of(Path(path).read_bytes())
    a, entries = tokencount.Automaton(pieces), set(pieces)
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in tokencount.counts(frame(spark), path).collect()}
    for i, t in enumerate(TEXTS):
        words = [w.decode() for w in (t or "").encode().split()]
        n = [slow(w, entries) if len(w) < 200 else a.pieces(w) for w in words]
        assert got[i] == (len(words), sum(1 if x is None else x for x in n), sum(x is None for x in n))
    assert tokencount.counts(frame(spark).limit(0), path).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "x " * 200_000)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_words) for r in tokencount.counts(odd, path).collect())
    assert got == [(False, 200_000), (True, 2), (True, 2)]
