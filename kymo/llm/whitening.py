"""Whitening of embeddings: centred, projected on the principal components, scaled to unit variance.

Two passes give the covariance. The first sums whole numbers exactly, which gives the mean as a fraction; the second
takes the centred vectors of each Arrow batch and adds their outer products by one matrix product. Partitions hand on one
matrix each, and ``treeAggregate`` merges them on executors, so the driver gets a few whatever the number of partitions. Its symmetric
eigenvectors (LAPACK ``eigh``) are broadcast for the projection. A third pass measures the covariance of what comes out.

Entries are x = floor(scale * c) + offset, whole numbers. Centred entries come from n*x - S, a whole number, rounded once
when it is divided by n: no offset, however large, costs digits.

Results, stated for every input: vectors that are null or empty, that hold null or non-finite entries, or an entry of
which scale * c reaches 2^62, take no part. The length that most vectors have (the longer of equally frequent ones) is
the number of dimensions, others take no part. A component whose variance is zero (up to rounding: e is at most
dimensions * 2^-52 of the greatest) can't be scaled: ``whitened`` is null there, ``explained`` is zero, and the identity
error covers the other components. ``deviation`` is null where the exact sum passes the range of long. Keys may be null
or repeat. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import tune

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**62
#: Rows of output that a batch holds: components times vectors.
OUT_ROWS = 1 << 16
LOW = (1 << 31) - 1


def whole(vectors: pa.Array, dimensions: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their entries as whole numbers)."""
    fits = pc.equal(pc.list_value_length(vectors), dimensions).fill_null(False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    c = vectors.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dimensions)
    with np.errstate(invalid="ignore", over="ignore"):
        c = np.floor(scale * c)  # null entries are NaN here
    good = (np.abs(c) < LARGEST).all(axis=1)
    return at[good], c[good].astype(np.int64) + offset


@dataclass
class Centre:
    """n vectors whose entries sum to S: a row x less the mean is (n*(x - floor) - rest) / n."""

    n: int
    floor: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        parts = [divmod(s, n) for s in sums]
        return cls(n, np.array([q for q, _ in parts], np.int64), np.array([r for _, r in parts], np.int64))

    def numerators(self, x: np.ndarray) -> np.ndarray | None:
        """n*x - S as longs, None where they might not fit."""
        y = x - self.floor
        if len(y) and (int(np.abs(y).max()) + 1) * self.n >= 2**62:
            return None
        return y * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = self.numerators(x)
        return (x - self.floor).astype(float) - self.rest / self.n if whole is None else whole / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n*x - S)^2."""
        whole = self.numerators(x)
        if whole is not None and (not len(whole) or int(np.abs(whole).max()) ** 2 * whole.shape[1] < 2**63):
            return (whole * whole).sum(axis=1).tolist()
        exact = ((x - self.floor).astype(object) * self.n - self.rest.astype(object)) if whole is None else whole.astype(object)
        return [s if s < 2**63 else None for s in (exact * exact).sum(axis=1).tolist()]


@dataclass
class Whitening:
    """What was fitted: centre, eigenvalues of the components and the projection, and how near the result is to the identity."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    total: float
    scale: int
    offset: int
    identity_error: float | None = None

    def projection(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; columns of components without variance are zero."""
        flat = self.flat()
        return np.where(flat, 0.0, self.vectors) / np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, self.values)))

    def flat(self) -> np.ndarray:
        most = self.values[0] if len(self.values) else 0.0
        return ~(self.values > len(self.vectors) * 2.0**-52 * most)

    def explained(self) -> np.ndarray:
        return np.where(self.flat(), 0.0, self.values) / (self.total if self.total > 0 else 1.0)


def _merge(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, centred outer products) of two sets of rows together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _block(z: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = z.mean(axis=0)
    centred = z - mean
    return len(z), mean, centred.T @ centred


def _summed(df: DataFrame, vector: str, per_partition: Callable[[Iterator[pa.Array]], Iterator[tuple]], schema: str, to_state: Callable, merge: Callable):
    """States of all partitions merged by treeAggregate: executors merge most, the driver gets about a root of their number."""
    arrow = {"long": pa.int64(), "binary": pa.binary()}
    kinds = [(p.split()[0], arrow[p.split()[1]]) for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in per_partition(b.column(0) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, kinds)], names=[n for n, _ in kinds])

    def either(a, b):
        return b if a is None else a if b is None else merge(a, b)

    states = df.select(df[vector].alias("v")).mapInArrow(run, schema).rdd
    return states.treeAggregate(None, lambda a, r: either(a, to_state(r)), either)


def dimensions_of(df: DataFrame, vector: str) -> int | None:
    """The length that most vectors have, the longer of equally frequent ones; None without vectors."""
    sizes = df.select(F.size(vector).alias("d")).filter("d > 0").groupBy("d").count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else None


def exact_sums(df: DataFrame, vector: str, dimensions: int, scale: int = SCALE, offset: int = OFFSET) -> tuple[int, list[int]]:
    """(number of usable vectors, exact sum of each dimension)."""

    def per_partition(vectors: Iterator[pa.Array]) -> Iterator[tuple]:
        n, sums = 0, [0] * dimensions
        for v in vectors:
            _, x = whole(v, dimensions, scale, offset)
            n += len(x)
            # upper and lower halves are summed apart: neither can overflow within a batch
            sums = [s + (h << 31) + low for s, h, low in zip(sums, (x >> 31).sum(axis=0).tolist(), (x & LOW).sum(axis=0).tolist())]
        if n:
            yield n, " ".join(map(str, sums)).encode()

    def merge(a, b):
        return a[0] + b[0], [s + t for s, t in zip(a[1], b[1])]

    found = _summed(df, vector, per_partition, "n long, sums binary", lambda r: (r["n"], [int(s) for s in bytes(r["sums"]).split()]), merge)
    return found or (0, [0] * dimensions)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """Whitening of all usable vectors of ``df``; None without any. A d*d matrix and d*components numbers are all that the driver holds."""
    tune(df.sparkSession)
    dimensions = dimensions_of(df, vector)
    if dimensions is None:
        return None
    n, sums = exact_sums(df, vector, dimensions, scale, offset)
    if not n:
        return None
    centre = Centre.of(n, sums)

    def products(vectors: Iterator[pa.Array]) -> Iterator[tuple]:
        total, rows = np.zeros((dimensions, dimensions)), 0
        for v in vectors:
            _, x = whole(v, dimensions, scale, offset)
            if len(x):
                d = centre.centred(x)
                total += d.T @ d
                rows += len(x)
        if rows:
            yield rows, total.tobytes()

    def matrix(r) -> np.ndarray:
        return np.frombuffer(bytes(r["m"])).reshape(dimensions, dimensions)

    covariance = _summed(df, vector, products, "n long, m binary", matrix, np.add) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    fitted = Whitening(centre, values[first], vectors[:, first], float(np.trace(covariance)), scale, offset)
    fitted.identity_error = identity_error(df, fitted, vector)
    return fitted


def identity_error(df: DataFrame, fitted: Whitening, vector: str = "embedding") -> float:
    """Greatest absolute entry of the whitened vectors' covariance less the identity, measured on all of them."""
    dimensions = len(fitted.vectors)
    shared = df.sparkSession.sparkContext.broadcast((fitted.projection(), fitted.centre))
    scale, offset = fitted.scale, fitted.offset

    def moments(vectors: Iterator[pa.Array]) -> Iterator[tuple]:
        projection, centre = shared.value
        held = None
        for v in vectors:
            _, x = whole(v, dimensions, scale, offset)
            if len(x):
                block = _block(centre.centred(x) @ projection)
                held = block if held is None else _merge(held, block)
        if held:
            yield held[0], np.concatenate([held[1], held[2].reshape(-1)]).tobytes()

    k = len(fitted.values)

    def state(r) -> tuple:
        numbers = np.frombuffer(bytes(r["m"]))
        return r["n"], numbers[:k], numbers[k:].reshape(k, k)

    n, _, products = _summed(df, vector, moments, "n long, m binary", state, _merge)
    wanted = np.diag((~fitted.flat()).astype(float))
    return float(np.abs(products / n - wanted).max())


def whiten(df: DataFrame, fitted: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a usable vector and component: (key, component, n, deviation, whitened, explained, identity_error).

    Vectors that were not fitted on may be whitened too. One narrow stage; ``fitted`` None gives no rows.
    """
    spark = df.sparkSession
    tune(spark)
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(df[key].alias("key"), df[vector].alias("v"))
    if fitted is None:
        return rows.limit(0).selectExpr("key", *(f"cast(null as {t}) as {c}" for c, t in (p.split() for p in schema.split(", ")[1:]))).withColumnRenamed("key", key)
    shared = spark.sparkContext.broadcast((fitted.projection(), fitted.flat(), fitted.explained(), fitted.centre))
    dimensions, scale, offset, error = len(fitted.vectors), fitted.scale, fitted.offset, fitted.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, flat, explained, centre = shared.value
        k = len(flat)
        for batch in batches:
            at, x = whole(batch.column(1), dimensions, scale, offset)
            for i in range(0, len(x), max(1, OUT_ROWS // k)):
                some, places = x[i : i + max(1, OUT_ROWS // k)], at[i : i + max(1, OUT_ROWS // k)]
                m = len(some)
                z = centre.centred(some) @ projection
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(places[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, centre.n)),
                        pa.array(centre.deviations(some), pa.int64()).take(pa.array(each)),
                        pa.array(z.reshape(-1), mask=np.tile(flat, m)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
