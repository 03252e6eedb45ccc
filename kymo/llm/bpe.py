"""Byte-level BPE encoding and decoding of whole texts with a public vocabulary file.

A text is cut at added tokens and then into words by the vocabulary's split pattern. Each word is merged on a
contiguous rank array: ``parts`` holds the ids between neighbouring part boundaries and ``ranks`` the merge rank
of each adjacent pair. The smallest rank is looked up by a scan, its boundary is deleted from both arrays and the
two neighbouring ranks are refreshed, until no pair can merge. Scanning is quadratic, which is the fastest way
for short words; a word of over ``LONG_WORD`` bytes takes the same merges in the same order from a heap.

Results: null counts as the empty text (no ids, empty decoded text). Repeated rows give repeated results. Texts of
any length are handled whole; the words of long texts are taken piecemeal so that memory stays in proportion to
the ids, not to Python objects for each word.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from array import array

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from kymo.llm.common import map_rows, tune

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# The split pattern of the byte-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space of the pattern is Unicode's White_Space property.
WHITE_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

LONG_WORD = 192
PIECE_CHARS = 1 << 20
PIECE_WORDS = 1 << 16
NO_MERGE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free letter from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = itertools.count(0x100)
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Words(dict):
    """Word to its ids as little-endian unsigned 32-bit integers; forgets all when it reaches its bound."""

    def __init__(self, codec: Codec, bound: int):
        super().__init__()
        self.codec, self.bound = codec, bound

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.codec.merge(word.encode("utf-8"))).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= self.bound:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder over one vocabulary file, given as its JSON text."""

    def __init__(self, vocabulary: str, cached_words: int = 300_000):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.tokens[i] = bytes(of_letter[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode("utf-8")
        pattern = WORD_PATTERN.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
        self.split = regex.compile(pattern)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.words = Words(self, cached_words)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << 32 | b, NO_MERGE) for a, b in itertools.pairwise(parts)]
        while ranks and (least := min(ranks)) < NO_MERGE:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], NO_MERGE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or rank_of(parts[i] << 32 | parts[j]) != rank:
                continue  # a neighbour has merged since
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank_of(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, of_word = [], self.words.__getitem__
        for segment in self.cut.split(text) if self.cut and any(t in text for t in self.added) else (text,):
            if segment in self.added:
                out.append(array("I", [self.added[segment]]).tobytes())
            elif len(segment) <= PIECE_CHARS:
                out.append(b"".join(map(of_word, self.split.findall(segment))))
            else:
                found = (m.group() for m in self.split.finditer(segment))
                while piece := list(itertools.islice(found, PIECE_WORDS)):
                    out.append(b"".join(map(of_word, piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def _mapped(df: DataFrame, vocabulary: str, per_batch, schema: str) -> DataFrame:
    tune(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:  # the driver's copy; executors get it by broadcast (a few MB)
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    held: list[Codec] = []

    def run(columns: dict) -> dict:
        if not held:
            held.append(Codec(spec.value))
        return per_batch(held[0], columns)

    return map_rows(df, run, schema)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids) of every row: ``ids`` are bytes, little-endian unsigned 32-bit integers."""

    def per_batch(codec: Codec, columns: dict) -> dict:
        ids = [codec.encode(t or "") for t in columns["text"].to_pylist()]
        return {"key": columns["key"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    kind = dict(df.dtypes)[key]
    return _mapped(df.select(df[key].alias("key"), df[text].alias("text")), vocabulary, per_batch, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text) of every row of ids as ``encode_texts`` gives them; null ids give the empty text."""

    def per_batch(codec: Codec, columns: dict) -> dict:
        return {"key": columns["key"], "text": [codec.decode(x or b"") for x in columns["ids"].to_pylist()]}

    kind = dict(df.dtypes)[key]
    return _mapped(df.select(df[key].alias("key"), df[ids].alias("ids")), vocabulary, per_batch, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text in one pass: (key, n_tokens, ids_sha256, decoded_sha256), with ``with_ids`` also ids.

    Decoded texts, and without ``with_ids`` the ids, never leave a worker and live for one row.
    """

    def per_batch(codec: Codec, columns: dict) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for value in columns["text"]:
            ids = codec.encode(value.as_py() or "")
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            if with_ids:
                out["ids"].append(ids)
        return out | {"key": columns["key"]}

    schema = f"key {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return _mapped(df.select(df[key].alias("key"), df[text].alias("text")), vocabulary, per_batch, schema).withColumnRenamed("key", key)
