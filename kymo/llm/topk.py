"""Exact top-k search by inner product over quantised vectors, with a three-phase uniform threshold.

The score of a candidate is a sum over ``LISTS`` blocks of dimensions; every partition of the candidates holds one list
of partial scores for each block. For each query:

1. Gather: from every list the k best by partial score. Their exact scores give, over all partitions, a k-th best
   score that the true k-th best is not below: the cutoff t.
2. Broadcast t. A candidate that reaches t has a partial score of at least t / LISTS in one of its lists (the lists'
   sum is t), so entries from there on suffice; every list gives these.
3. Resolve: the exact scores of these entries, of which each partition hands on its k best by (score, vec_id) that
   reach t. The k best of these are the answer.

Queries are taken in blocks of about ``BLOCK`` rows, which bounds what the driver holds and what is broadcast (BLOCK * dim * 8
bytes, and a cutoff a query); each block's result is added to one folder of the shared ones. Scores are int64: components whose products could leave the
53 bits that float64 products keep exact are multiplied in int64, and beyond that in Python's integers.

Results: ties go to the smaller vec_id. Vectors that are null, or hold null or non-finite components, take no part,
neither does a row without vec_id; a vec_id that isn't a whole number is an error. A query's own row is left out, not other rows that repeat its vec_id. Vectors of
another length than the query's are no candidates for it. Scores beyond int64 count as its limits, and so tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymo.llm.common import fresh_path, numbered, tune, whole_key

LISTS, BLOCK, CHUNK = 4, 4096, 8192
#: Scores of one piece of queries against one chunk of candidates that are held at once.
PIECE_SCORES = 1 << 22


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, v) of the rows that take part, written with their numbers; v holds doubles."""
    v = F.col(vector)
    plain = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    plain_rows = df.filter(plain & F.col(key).isNotNull())
    rows, row = numbered(plain_rows.select(whole_key(plain_rows, key).alias("vec_id"), v.cast("array<double>").alias("v")), "top-k-vectors")
    return rows.select(F.col(row).alias("row"), "vec_id", "v")


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.floor(256 * np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)) for x in column]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of whole doubles, as int64 (or objects beyond it)."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return exact(a).dot(exact(b).T)


def _int64(scores: np.ndarray) -> np.ndarray:
    """Scores as int64, those beyond it as its limits."""
    if scores.dtype != object:
        return scores
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in scores], np.int64)


class Block:
    """Queries of one length: their rows, ids and matrix."""

    def __init__(self, rows: list[int], ids: list[int], matrix: np.ndarray):
        self.rows, self.ids, self.matrix = np.array(rows, np.int64), np.array(ids, np.int64), matrix


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, vec_id, matrix) of up to CHUNK candidates of one length, ordered by vec_id."""
    held: dict[int, list] = {}

    def flush(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, vec_id = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        order = np.lexsort((row, vec_id))
        return row[order], vec_id[order], np.stack([parts[i][2] for i in order])

    for batch in batches:
        for row, vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2))):
            parts = held.setdefault(len(v), [])
            parts.append((row, vec_id, v))
            if len(parts) >= CHUNK:
                yield flush(held.pop(len(v)))
    for parts in held.values():
        yield flush(parts)


def _slices(dim: int) -> list[slice]:
    edges = [dim * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _pieces(block: Block, n: int) -> Iterator[slice]:
    step = max(1, PIECE_SCORES // max(1, n))
    for at in range(0, len(block.rows), step):
        yield slice(at, min(at + step, len(block.rows)))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices [query, k] of the highest scores, lower index first among equals; all of them if fewer."""
    n = scores.shape[1]
    if scores.dtype == object:
        return np.array([sorted(range(n), key=lambda i: (-r[i], i))[:k] for r in scores]).reshape(len(scores), -1)
    if np.abs(scores).max(initial=0) < 2**62 // max(1, n):
        keys = scores * n + np.arange(n - 1, -1, -1)
    else:
        return np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]
    if n <= k:
        return np.argsort(-keys, axis=1)
    some = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(keys, some, 1), axis=1), 1)


def _gather(blocks, k: int):
    """Phase 1: (q, scores) for every query: exact scores of the entries that lead a list of this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[int]] = {}
        for row, _, matrix in _chunks(batches):
            for block in blocks.value:
                if block.matrix.shape[1] != matrix.shape[1]:
                    continue
                for piece in _pieces(block, len(row)):
                    q = block.matrix[piece]
                    lead = np.concatenate([_best(products(q[:, s], matrix[:, s]), k + 1) for s in _slices(q.shape[1])], axis=1)
                    for i, (query_row, found) in enumerate(zip(block.rows[piece], lead)):
                        found = np.unique(found)
                        found = found[row[found] != query_row]
                        mine = best.setdefault(int(query_row), [])
                        mine += _int64(products(q[i : i + 1], matrix[found])[0]).tolist()
                        best[int(query_row)] = sorted(mine, reverse=True)[:k]
        flat = [(q, s) for q, scores in best.items() for s in scores]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64())], names=["q", "score"])

    return run


def _resolve(blocks, cutoffs, k: int):
    """Phases 2 and 3: (q, query_id, vec_id, score) of the entries of this partition that reach their query's cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, vec_id, matrix in _chunks(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for block in blocks.value:
                if block.matrix.shape[1] != matrix.shape[1]:
                    continue
                for piece in _pieces(block, len(row)):
                    q, rows = block.matrix[piece], block.rows[piece]
                    cut = [cutoffs.value.get(int(r)) for r in rows]
                    partial = [products(q[:, s], matrix[:, s]) for s in _slices(q.shape[1])]
                    least = np.array([-np.inf if c is None else c / LISTS for c in cut])[:, None]
                    enough = np.zeros(partial[0].shape, bool)
                    for p in partial:
                        # a shade below the bound: rounding of a large quotient must not lose an entry
                        enough |= p >= least - np.abs(least) * 1e-9 if p.dtype != object else np.ones(p.shape, bool)
                    for i in range(len(rows)):
                        at = np.flatnonzero(enough[i])
                        at = at[row[at] != rows[i]]
                        if not len(at):
                            continue
                        scores = _int64(sum(p[i, at] for p in partial))
                        keep = np.ones(len(at), bool) if cut[i] is None else scores >= cut[i]
                        at, scores = at[keep], scores[keep]
                        if not len(at):
                            continue
                        best = _best(scores[None, :], k)[0]
                        out[0].extend([int(rows[i])] * len(best))
                        out[1].extend([int(block.ids[piece][i])] * len(best))
                        out[2].extend(vec_id[at[best]].tolist())
                        out[3].extend(scores[best].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["q", "query_id", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame) -> Iterator[list[Block]]:
    """Queries in blocks of about BLOCK rows, each of which is read to the driver by a job of its own.

    They are dealt by a hash of their rows and written by block, so that a job reads one block's files only.
    """
    spark, n = queries.sparkSession, queries.count()
    if not n:
        return
    path, blocks = fresh_path(spark, "top-k-queries"), -(-n // BLOCK)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    dealt.repartition(min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").write.partitionBy("block").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    for block in range(blocks):
        held: dict[int, list] = {}
        for r in stored.filter(F.col("block") == block).orderBy("row").collect():
            held.setdefault(len(r["v"]), []).append((r["row"], r["vec_id"], r["v"]))
        if held:
            yield [Block([p[0] for p in parts], [p[1] for p in parts], np.floor(256 * np.array([p[2] for p in parts], np.float64).reshape(len(parts), dim))) for dim, parts in held.items()]


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row for which the Column ``is_query`` (over vec_id) holds, against all rows of ``df``."""
    spark = df.sparkSession
    tune(spark)
    candidates = usable(df, key, vector)
    path, some = fresh_path(spark, "top-k"), False
    for blocks in _blocks(candidates.filter(is_query)):
        shared = spark.sparkContext.broadcast(blocks)
        order = Window.partitionBy("q").orderBy(F.desc("score"))
        gathered = candidates.mapInArrow(_gather(shared, k), "q long, score long").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
        # a cutoff only where k entries were found; one number a query of the block
        found = gathered.filter(F.col("n") == k).select("q", "score").collect()
        cutoffs = spark.sparkContext.broadcast({r["q"]: r["score"] for r in found})
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        part = candidates.mapInArrow(_resolve(shared, cutoffs, k), "q long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        part.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)  # blocks have no query in common
        some = True
        shared.unpersist()
        cutoffs.unpersist()
    return spark.read.schema(RESULT).parquet(path) if some else spark.createDataFrame([], RESULT)
