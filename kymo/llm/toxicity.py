"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words (runs of letters) and their first four and five letters, hashed
into ``BUCKETS``. score = sigmoid(b + sum w_j + sum over pairs <v_j, v_k> / n) over the n terms of a text: the pair part,
computed in linear time as (|sum v_j|^2 - sum |v_j|^2) / 2n, learns what only two terms together mean, such as an
insult next to the mention of a group, which additive weights miss.

The machine is fitted on the driver on a bounded sample of labelled rows: ``max_per_class`` of each class, the first
by a seeded hash of their key; a class that was sampled is weighted back to its full count. Scoring covers every
whole text on the executors. Most of a text's words say nothing about its label. Of the terms in at least ``MIN_DOCS``
texts of the sample the machine has those about which the sample says anything: a term that is more frequent in one
class (standard score of ``MIN_CONTRAST``), or one that says nothing alone but does with another (``paired``), as where
a text is toxic if it has an insult or a group but not both.

Results: null and empty texts get the score of the intercept alone. Labels that are null are ignored; where a key has
several labels the largest counts. Rows that repeat a key are each scored on their own text. Without any labelled
row, or with one class only, every score is that class's share (0 without rows).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import lowest, map_rows, tune

BUCKETS = 1 << 18
FACTORS = 4
MIN_DOCS, MIN_CONTRAST = 3, 3.5
#: Standard score that a pair needs beyond what its terms have alone, share of texts that its terms are in, and terms compared at once.
MIN_PAIR, PAIR_SHARE, PAIR_BLOCK = 6.0, 0.01, 512
THRESHOLD = 0.3
MAX_PER_CLASS = 4000
CACHED_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of one word: itself, and its first four and five letters where it is longer."""
    terms = [zlib.crc32(b"w" + word.encode("utf-8"))]
    terms += [zlib.crc32(b"p" + word[:n].encode("utf-8")) for n in (4, 5) if len(word) > n]
    return tuple(t % BUCKETS for t in terms)


class Terms(dict):
    """Word to its terms (those in ``known`` where given); forgets all when full."""

    def __init__(self, known: frozenset[int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = word_terms(word)
        if self.known is not None:
            found = tuple(t for t in found if t in self.known)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str | None) -> set[int]:
        words = set(_WORD.findall((text or "").lower()))
        return set().union(*map(self.__getitem__, words))


@dataclass
class FactorizationMachine:
    """Weights of the terms in ``index`` (sorted): ``w`` of shape (n,), ``v`` of shape (n, factors)."""

    bias: float
    index: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def score(self, terms: set[int]) -> float:
        """Probability of label 1; every term must be in ``index``."""
        z = self.bias
        if terms:
            at = np.searchsorted(self.index, np.fromiter(sorted(terms), np.int64, len(terms)))
            x = 1 / math.sqrt(len(at))
            v = self.v[at]
            z += float(self.w[at].sum()) + 0.5 * x * x * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def contrast(zeros: np.ndarray, ones: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Squared standard score of a share of class 1 against one of class 0 (two-proportion test, pooled variance)."""
    pooled = (zeros + ones) / (n0 + n1)
    return (ones / n1 - zeros / n0) ** 2 / np.maximum(pooled * (1 - pooled) * (1 / n0 + 1 / n1), 1e-12)


def paired(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Terms that say something about the label together with another: where both are, or where just one of them is.

    Counted over all pairs of terms in at least ``PAIR_SHARE`` of the texts, in blocks of terms. A pair's squared score must
    be ``MIN_PAIR`` ** 2 above twice what its terms have, so words of one topic or language, which go together
    anyway, add nothing.
    """
    common = np.flatnonzero(counts >= max(MIN_DOCS, PAIR_SHARE * len(rows)))
    place = np.full(BUCKETS, -1, np.int32)
    place[common] = np.arange(len(common))
    held = []  # of each class: texts, and (term, text) by term
    for label in (0, 1):
        mine = [r for r, y in zip(rows, labels) if y == label]
        term, text, at = np.empty(sum(map(len, mine)), np.int32), np.empty(sum(map(len, mine)), np.int32), 0
        for i, r in enumerate(mine):
            some = place[r]
            some = some[some >= 0]
            term[at : at + len(some)], text[at : at + len(some)] = some, i
            at += len(some)
        order = np.argsort(term[:at], kind="stable")
        held.append((len(mine), term[order], text[order]))
        del term, text, order

    def block(of: tuple, at: int) -> np.ndarray:
        n, term, text = of
        some = slice(*np.searchsorted(term, [at, at + PAIR_BLOCK]))
        out = np.zeros((n, min(PAIR_BLOCK, len(common) - at)), np.float32)
        out[text[some], term[some] - at] = 1
        return out

    (n0, *_), (n1, *_) = held
    alone = [np.bincount(term, minlength=len(common)).astype(float) for _, term, _ in held]
    own, hit = contrast(*alone, n0, n1), np.zeros(len(common), bool)
    for i in range(0, len(common), PAIR_BLOCK):
        left = [block(h, i) for h in held]
        for j in range(i, len(common), PAIR_BLOCK):
            a, b = slice(i, i + PAIR_BLOCK), slice(j, j + PAIR_BLOCK)
            both = [(x.T @ block(h, j)).astype(float) for x, h in zip(left, held)]
            either = [c[a][:, None] + c[b] - 2 * k for c, k in zip(alone, both)]
            need = 2 * (own[a][:, None] + own[b]) + MIN_PAIR**2
            told = (contrast(*both, n0, n1) >= need) | (contrast(*either, n0, n1) >= need)
            hit[a] |= told.any(axis=1)
            hit[b] |= told.any(axis=0)
    return common[hit]


def telling(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms that a machine is fitted on, sorted."""
    if not any(map(len, rows)):
        return np.empty(0, np.int64)
    zeros, ones = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r, y in zip(rows, labels):
        (ones if y else zeros)[r] += 1  # the terms of a text differ
    counts = zeros + ones
    n1 = int(labels.sum())
    alone = np.flatnonzero((counts >= MIN_DOCS) & (contrast(zeros, ones, len(labels) - n1, n1) >= MIN_CONTRAST**2))
    return np.union1d(alone, paired(rows, labels, counts))


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.15, l2: float = 2e-5, seed: int = 7) -> FactorizationMachine:
    """Adagrad on weighted logistic loss over mini-batches; rows are arrays of distinct terms."""
    none = FactorizationMachine(0.0, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    positive = float((weights * labels).sum() / weights.sum()) if len(rows) else 0.0
    if positive in (0.0, 1.0):
        none.bias = 50.0 if positive else -50.0
        return none
    index = telling(rows, labels)
    place = np.full(BUCKETS, -1, np.int64)
    place[index] = np.arange(len(index))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(index)), rng.normal(0, 0.05, (len(index), FACTORS)), math.log(positive / (1 - positive))
    gw, gv, gb = np.full(len(index), 1e-6), np.full((len(index), FACTORS), 1e-6), 1e-6
    weights = weights / weights.mean()
    order = rng.permutation(len(rows))
    for _ in range(epochs):
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            sizes = np.array([len(rows[i]) for i in some])
            terms, doc = np.concatenate([rows[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
            x = 1 / np.sqrt(np.maximum(sizes, 1))
            sums = np.stack([np.bincount(doc, v[terms, f], len(some)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(doc, (v[terms] ** 2).sum(axis=1), len(some))
            z = bias + np.bincount(doc, w[terms], len(some)) + 0.5 * x * x * ((sums**2).sum(axis=1) - squares)
            delta = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[some]) * weights[some] / len(some)
            used, where = np.unique(terms, return_inverse=True)
            grad = np.bincount(where, delta[doc], len(used)) + l2 * w[used]
            gw[used] += grad**2
            w[used] -= rate * grad / np.sqrt(gw[used])
            pull = (delta * x * x)[doc]
            for f in range(FACTORS):
                grad = np.bincount(where, pull * (sums[doc, f] - v[terms, f]), len(used)) + l2 * v[used, f]
                gv[used, f] += grad**2
                v[used, f] -= 0.5 * rate * grad / np.sqrt(gv[used, f])
            gb += delta.sum() ** 2
            bias -= rate * delta.sum() / math.sqrt(gb)
    return FactorizationMachine(float(bias), index, w, v)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", usable=None, max_per_class: int = MAX_PER_CLASS, seed: int = 7) -> FactorizationMachine:
    """Fit on at most ``max_per_class`` labelled rows of each class for which ``usable`` (a Column of the labels) holds."""
    tune(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    parts = [lowest(known.filter(F.col("y") == y), order, max_per_class, totals.get(y, 0)) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # at most 2 * max_per_class keys
    texts = docs.select(docs[key], docs[text].alias("text")).join(chosen, key).groupBy(key, "y").agg(F.min("text").alias("text"))
    of = Terms()

    def terms(columns: dict) -> dict:
        return {"key": columns[key].cast("string"), "y": columns["y"], "terms": [np.array(sorted(of.of(t.as_py())), np.int32).tobytes() for t in columns["text"]]}

    sample = sorted(map_rows(texts, terms, "key string, y int, terms binary").collect(), key=lambda r: r["key"])
    y = np.array([r["y"] for r in sample], float)
    share = {k: totals.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    return fit([np.frombuffer(bytes(r["terms"]), np.int32) for r in sample], y, np.array([share[int(k)] for k in y]))


def score(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights: 10 MB
    held: list[Terms] = []

    def per_batch(columns: dict) -> dict:
        if not held:
            held.append(Terms(frozenset(shared.value.index.tolist())))
        return {"key": columns["key"], "score": [shared.value.score(held[0].of(t.as_py())) for t in columns["text"]]}

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_rows(rows, per_batch, f"key {dict(docs.dtypes)[key]}, score double").withColumnRenamed("key", key)


def is_held_out(key: str = "doc_id"):
    """True for the keys whose labels are never learned from: crc32(key as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without the rows scored at ``threshold`` or above."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Terms] = []
    at = docs.columns.index(text)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            if not held:
                held.append(Terms(frozenset(shared.value.index.tolist())))
            yield batch.filter(pa.array([shared.value.score(held[0].of(t.as_py())) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
