"""SentencePiece encoding and decoding (merge type, byte fallback) of whole texts with a public model file.

The text a merge-type model gives to a string is the only one whose pieces each merge to themselves and whose
neighbours each merge to just the two of them: until a merge crosses a boundary, both sides go their way alone, so a first
crossing would show in the pair as well. Encoding looks for that text from left to right. An Aho-Corasick automaton
finds the longest piece at every position; a piece is taken if it goes with the piece before (checked by merging both
again, once for each pair) and its end isn't known to fail; otherwise the next shorter piece that it begins with is
tried. Where none is left, the position is marked in a bitfield and the piece before is taken back. The pieces of a valid
prefix are unique, so a failed position fails whatever led to it, and each is left once: time is linear in the text.

Where no piece of the model holds two characters side by side, none crosses a place between these, and a text may be cut there. So
if a space mark never stands behind another character, a text falls into words that are encoded one by one (and kept, up to
a bound). Characters that merge with nothing, and punctuation that never stands behind a letter, are cut off alike.

Results: null counts as the empty text (begin and end ids only, empty decoded text). Repeated rows give repeated
results. Texts of any length are handled whole.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
from pyspark.sql import DataFrame

from kymo.llm.common import map_rows, tune

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")

# The mark that stands for a space, what an unknown piece decodes to, and kinds of pieces and models in a model file.
MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2

LETTER = r"[^\W\d_]"

LONG_WORD = 192
PIECE_CHARS = 1 << 20


def _each_wrong_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("kymo-each-byte", _each_wrong_byte)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message; nested messages and strings are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, message[at : at + size]
            at += size


class Model:
    """What a model file says: pieces with scores and kinds, and how texts are prepared."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in fields(data):
            if number == 1:
                piece = {1: b"", 2: bytes(4), 3: NORMAL} | dict(fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError("the model isn't of the merge type")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models that leave characters as they are and mark spaces are known")
        if other := {*self.kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"pieces of the kinds {sorted(other)} aren't known")
        self.prefixed = bool(normalizer.get(3, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.surface = trainer[44].decode("utf-8") if 44 in trainer else UNKNOWN_SURFACE
        self.unknown = self.kinds.index(UNKNOWN)
        self.begin, self.end = (self.pieces.index(trainer[n].decode("utf-8") if n in trainer else p) for n, p in ((46, "<s>"), (47, "</s>")))


class Words(dict):
    """Word to its ids; forgets all when it reaches its bound."""

    def __init__(self, codec: Codec, bound: int):
        super().__init__()
        self.codec, self.bound = codec, bound

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.word(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.bound:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one model. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, data: bytes, cached_words: int = 300_000, cached_pairs: int = 2_000_000):
        self.model = m = Model(data)
        self.cached_pairs = cached_pairs
        self.words = Words(self, cached_words)
        self.pairs: dict[int, bool] = {}
        self.text_of = list(m.pieces)
        self.id_of = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] == NORMAL}
        self.score_of = {p: m.scores[i] for p, i in self.id_of.items()}
        known = {c for p in self.id_of for c in p}
        for c in sorted(known - self.id_of.keys()):  # parts that aren't pieces: they may merge, and fall back to bytes if not
            self.id_of[c] = len(self.text_of)
            self.text_of.append(c)
        self.length = [len(p) for p in self.text_of]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) > 1:
                self.automaton.add_word(p, (i, len(p)))
        self.single = {p: i for p, i in self.id_of.items() if len(p) == 1}.get
        self.width = len(self.text_of)
        self.automaton.make_automaton()
        self.matches = self.automaton.iter if len(self.automaton) else lambda text: ()
        #: For each piece the longest other one that it begins with, -1 if none.
        self.shorter = [-1] * len(self.text_of)
        for p, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), -1)
        of_byte = {int(p[1:-1], 16): i for i, p in enumerate(m.pieces) if m.kinds[i] == BYTE}
        self.byte_ids = [of_byte.get(b, m.unknown) for b in range(256)]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else m.surface.encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds)]
        self.controls = {i for i, k in enumerate(m.kinds) if k == CONTROL}
        self.whole_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        joined = {c for p in self.id_of if len(p) > 1 for c in p}
        behind_letters = {b for p in self.id_of for a, b in zip(p, p[1:]) if re.match(LETTER, a)}
        ascii_ = [chr(c) for c in range(128) if chr(c) != " "]
        alone = "".join(re.escape(c) for c in ascii_ if c not in joined)
        ends = "".join(re.escape(c) for c in ascii_ if c not in behind_letters and not re.match(LETTER, c))
        words = [f"{MARK}*+{LETTER}++(?=[{ends}])"] * bool(ends) + [f"{MARK}+[^{MARK}{alone}]*", f"[^{MARK}{alone}]+"] + [f"[{alone}]"] * bool(alone)
        self.cut = re.compile("|".join(words))

    def merge(self, text: str) -> list[str]:
        """Parts of a short text when the pair with the best score, the leftmost of equal ones, merges until none can."""
        parts = list(text)
        scores = [self.score_of.get(a + b) for a, b in zip(parts, parts[1:])]
        while known := [s for s in scores if s is not None]:
            i = scores.index(max(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.score_of.get(parts[i - 1] + parts[i])
            if i < len(scores):
                scores[i] = self.score_of.get(parts[i] + parts[i + 1])
        return parts

    def together(self, left: int, right: int) -> bool:
        """Whether ``right`` stands behind ``left`` (-1: nothing): both, merged again from characters, give just these two."""
        two = [self.text_of[i] for i in (left, right) if i >= 0]
        found = self.merge("".join(two)) == two
        if len(self.pairs) >= self.cached_pairs:
            self.pairs.clear()
        self.pairs[left * self.width + right] = found
        return found

    def tokens(self, text: str) -> list[int]:
        """Pieces of a text by their numbers; -1 for a character that no piece holds."""
        n, length, shorter, known, width = len(text), self.length, self.shorter, self.pairs.get, self.width
        single = self.single
        longest = [single(c, -1) for c in text]
        for end, (i, size) in self.matches(text):
            longest[end - size + 1] = i  # longer ones end later
        failed = None  # the bitfield, once a position fails
        out: list[int] = []
        at, before = 0, -1
        while at < n:
            token = longest[at]
            if token < 0:  # merges with nothing, so anything may stand beside it
                end = at + 1
            else:
                while True:
                    while token >= 0:
                        end = at + length[token]
                        if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                            fits = known(before * width + token)
                            if self.together(before, token) if fits is None else fits:
                                break
                        token = shorter[token]
                    if token >= 0:
                        break
                    if failed is None:
                        failed = bytearray(n // 8 + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    back = out.pop()
                    at -= length[back]
                    token = shorter[back]  # the end of that piece has failed: the next shorter one is tried
                    before = out[-1] if out else -1
            out.append(token)
            before = token
            at = end
        return out

    def word(self, word: str) -> bytes:
        """Ids of one word."""
        tokens, known = self.tokens(word), len(self.model.pieces)
        if not tokens or (min(tokens) >= 0 and max(tokens) < known):
            return array("I", tokens).tobytes()
        ids, at = array("I"), 0
        for t in tokens:
            size = 1 if t < 0 else self.length[t]
            if 0 <= t < known:
                ids.append(t)
            elif self.model.byte_fallback:
                ids.extend(self.byte_ids[b] for b in word[at : at + size].encode("utf-8"))
            elif not ids or ids[-1] != self.model.unknown:
                ids.append(self.model.unknown)
            at += size
        return ids.tobytes()

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids of a whole text, with ``ends`` between the ids of begin and end."""
        out, of_word = [], self.words.__getitem__
        if text:
            marked = (MARK if self.model.prefixed else "") + text.replace(" ", MARK)
            if not self.whole_words or not self.model.byte_fallback:  # unknown characters in a row are one id without fallback
                out.append(of_word(marked))
            elif len(marked) <= PIECE_CHARS:
                out.extend(map(of_word, self.cut.findall(marked)))
            else:
                out.extend(of_word(m.group()) for m in self.cut.finditer(marked))
        first, last = (struct.pack("<I", i) if ends else b"" for i in (self.model.begin, self.model.end))
        return b"".join([first, *out, last])

    def decode(self, ids: bytes) -> str:
        """The text of ids. Controls give nothing; each byte of a run of byte pieces that isn't UTF-8 gives U+FFFD."""
        numbers = memoryview(ids).cast("I").tolist()
        low, high = 0, len(numbers)
        while low < high and numbers[low] in self.controls:
            low += 1
        while low < high and numbers[high - 1] in self.controls:
            high -= 1
        if low == high:
            return ""
        first, numbers = numbers[low], numbers[low:high]
        if self.controls.isdisjoint(numbers):
            text = b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "kymo-each-byte")
        else:  # a control ends a run of byte pieces
            runs: list[list[bytes]] = [[]]
            for x in numbers:
                if x in self.controls:
                    runs.append([])
                else:
                    runs[-1].append(self.bytes_of[x])
            text = "".join(b"".join(r).decode("utf-8", "kymo-each-byte") for r in runs)
        dropped = self.model.prefixed and self.model.kinds[first] == NORMAL and self.model.pieces[first].startswith(MARK)
        return text[1:] if dropped else text


def _mapped(df: DataFrame, model: str, per_batch, schema: str) -> DataFrame:
    tune(df.sparkSession)
    with open(model, "rb") as file:  # the driver's copy; executors get it by broadcast (half a MB)
        data = df.sparkSession.sparkContext.broadcast(file.read())
    held: list[Codec] = []

    def run(columns: dict) -> dict:
        if not held:
            held.append(Codec(data.value))
        return per_batch(held[0], columns)

    return map_rows(df, run, schema)


def _keyed(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(df[key].alias("key"), df[value].alias("value"))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL, ends: bool = True) -> DataFrame:
    """(key, n_tokens, ids) of every row: ``ids`` are bytes, little-endian unsigned 32-bit integers."""

    def per_batch(codec: Codec, columns: dict) -> dict:
        ids = [codec.encode(t.as_py() or "", ends) for t in columns["value"]]
        return {"key": columns["key"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return _mapped(_keyed(df, key, text), model, per_batch, f"key {dict(df.dtypes)[key]}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """(key, text) of every row of ids as ``encode_texts`` gives them; null ids give the empty text."""

    def per_batch(codec: Codec, columns: dict) -> dict:
        return {"key": columns["key"], "text": [codec.decode(x.as_py() or b"") for x in columns["value"]]}

    return _mapped(_keyed(df, key, ids), model, per_batch, f"key {dict(df.dtypes)[key]}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """Encode and decode every text in one pass: (key, n_tokens, ids_sha256, decoded_sha256).

    Ids and decoded texts never leave a worker and live for one row.
    """

    def per_batch(codec: Codec, columns: dict) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for value in columns["value"]:
            ids = codec.encode(value.as_py() or "")
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
        return out | {"key": columns["key"]}

    schema = f"key {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(_keyed(df, key, text), model, per_batch, schema).withColumnRenamed("key", key)
