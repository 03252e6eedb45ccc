"""SentencePiece encoding against the sentencepiece library."""

import hashlib
import random
import struct
import time
from array import array

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kymo.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        return pieces.Codec(f.read())


def same(library, codec, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    got = codec.encode(text)
    assert array("I", want).tobytes() == got, text
    assert library.decode(want) == codec.decode(got), text


ALPHABET = list("aab  \n\t'stré1２　\x1c\x85?!\x00▁") + ["<s>", "</s>", "<unk>", "<0x0A>", "ſ", "​", "🙂", "́", "the", "ing", "  ", "    ", "한국", "日本"]


@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_odd_texts(library, codec, text):
    same(library, codec, text)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_text(library, codec, text):
    same(library, codec, text)


@given(st.lists(st.integers(0, 31999) | st.integers(0, 270), max_size=12))
@settings(max_examples=400, deadline=None)
def test_any_ids_decode_alike(library, codec, ids):
    assert library.decode(ids) == codec.decode(array("I", ids).tobytes())


def test_letters_without_words(library, codec):
    rng = random.Random(3)
    for letters in ("etaoinshr", "ab", "aabc ", "enrt▁ ", "0123456789", "абвгдежз", "的一是不了人我在有他"):
        for n in (1, 2, 3, 7, 50, 400):
            for _ in range(20):
                same(library, codec, "".join(rng.choice(letters) for _ in range(n)))


def test_merging_of_every_piece(library, codec):
    """Pieces behind each other in any order: what two of them merge to."""
    rng = random.Random(4)
    plain = [p for p, k in zip(codec.model.pieces, codec.model.kinds) if k == pieces.NORMAL]
    texts = ["".join(rng.choices(plain, k=6)) for _ in range(5000)] + plain
    for text, want in zip(texts, library.encode(texts, add_bos=True, add_eos=True)):
        assert array("I", want).tobytes() == codec.encode(text), text


def test_long_texts_take_linear_time(library, codec):
    rng = random.Random(5)
    for letters in ("a", "etaoin", "ab"):
        text = "".join(rng.choice(letters) for _ in range(300_000))
        began = time.perf_counter()
        same(library, codec, text)
        assert time.perf_counter() - began < 20
    same(library, codec, " ".join("word" + str(i) for i in range(150_000)))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_of(plain, fallback=True, prefixed=True, kind=2):
    """A model file with the given pieces, the best first."""
    named = [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256) if fallback]
    body = b"".join(field(1, field(1, p.encode()) + field(2, 0.0) + field(3, k)) for p, k in named)
    body += b"".join(field(1, field(1, p.encode()) + field(2, -float(i))) for i, p in enumerate(plain))
    trainer = field(3, kind) + field(35, int(fallback))
    return body + field(2, trainer) + field(3, field(1, b"identity") + field(3, int(prefixed)) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("prefixed", [True, False])
def test_small_vocabularies(fallback, prefixed):
    """Random vocabularies: parts that are no pieces, pieces that can't be reached, and pieces that cross words."""
    rng = random.Random(6)
    for round in range(60):
        letters = "abc▁"
        plain = {"".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(25)}
        plain = list(plain | set(rng.sample(letters, rng.randint(1, 4))))
        rng.shuffle(plain)
        data = model_of(plain, fallback, prefixed)
        library, codec = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(data)
        for _ in range(60):
            same(library, codec, "".join(rng.choices("abc ▁é\n", k=rng.randint(0, 25))))


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merge type"):
        pieces.Codec(model_of(["a"], kind=1))


def test_bounded_caches_change_nothing(library):
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        codec = pieces.Codec(f.read(), cached_words=5, cached_pairs=7)
    same(library, codec, "Some words, some more words and the same words again; " * 20)


def test_frames(spark, library):
    long = "word " * 100_000
    texts = [None, "", " ", "a b", "a b", "naïve ▁ 🙂\n", long]
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)] + [(None, "no key", "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, value double")
    got = {r["doc_id"]: r for r in pieces.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    decoded = pieces.decode_ids(pieces.encode_texts(df))
    assert {r["doc_id"]: r["text"] for r in decoded.collect()} == {i: (t or "").replace("▁", " ") for i, t, *_ in rows}
    assert pieces.round_trip(df.limit(0)).count() == 0
    bare = pieces.encode_texts(df.filter(F.col("doc_id") == 3), ends=False).first()
    assert array("I", bytes(bare["ids"])).tolist() == library.encode("a b")


def test_query(spark, library):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op11_pieces"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
