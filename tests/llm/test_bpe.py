"""Byte-level BPE against the tokenizers library."""

import hashlib
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kymo.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    with open(bpe.DEFAULT_VOCABULARY, encoding="utf-8") as f:
        return bpe.Codec(f.read())


def same(library, codec, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert array("I", want).tobytes() == got, text
    assert library.decode(want, skip_special_tokens=False) == codec.decode(got) == text


ALPHABET = list("aab  \n\t'stré1２　\x1c\x85?!") + ["<|endoftext|>", "'ll", "'S", "ſ", "​", "🙂", "́"]


@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join))
@settings(max_examples=150, deadline=None)
def test_odd_texts(library, codec, text):
    same(library, codec, text)


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_text(library, codec, text):
    same(library, codec, text)


def test_every_letter_between_others(library, codec):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{c}a1 {c}{c}  {c}" for c in letters]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert array("I", found.ids).tobytes() == codec.encode(text), hex(ord(text[1]))


def test_long_words_take_the_same_merges(library, codec):
    rng = random.Random(2)
    for n in (191, 192, 193, 5000):
        same(library, codec, "".join(rng.choice("etaoinshr") for _ in range(n)))
    same(library, codec, "a" * 3000)


def test_long_texts_in_pieces(library, codec, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    monkeypatch.setattr(bpe, "PIECE_WORDS", 3)
    same(library, codec, "It's 12 o'clock;  we'll see \n\n" * 40)


def test_a_full_cache_forgets(codec):
    with open(bpe.DEFAULT_VOCABULARY, encoding="utf-8") as f:
        small = bpe.Codec(f.read(), cached_words=2)
    text = "one two three four five one two"
    assert small.encode(text) == codec.encode(text) and len(small.words) <= 2


def test_bytes_that_are_no_text(codec):
    ids = array("I", [codec.byte_ids[b] for b in b"a\xff\xe2\x82b"]).tobytes()
    assert codec.decode(ids) == b"a\xff\xe2\x82b".decode("utf-8", "replace")


def test_frames(spark, library):
    rows = [(1, "Hello, world!", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "tail " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip(df).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), sha(array("I", ids).tobytes()), sha((text or "").encode())))
    assert got == sorted(want, key=repr)
    encoded = bpe.encode_texts(df)
    assert sorted((r["doc_id"], r["text"]) for r in bpe.decode_ids(encoded).collect() if r["doc_id"]) == [(1, "Hello, world!"), (2, ""), (3, ""), (3, "")]
    with_ids = bpe.round_trip(df, with_ids=True)
    assert {r["n_tokens"] * 4 == len(r["ids"]) for r in with_ids.collect()} == {True}
    assert bpe.round_trip(df.limit(0)).count() == 0
