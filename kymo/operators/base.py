"""Trials as DataFrame rows, and the kinds of operators over their tensor columns.

A tensor column is an ``array<double>`` in row-major order whose shape is static and kept beside the plan, so shapes
are inferred and errors raised when a plan is built, without touching data. A column of shape () is a plain double.

* ``ColumnOperator``: a Catalyst expression. Neighbours collapse into one projection.
* ``BatchOperator``: numpy over Arrow batches of trials (``arrow_udf``). Neighbours run in one Python pass, as Spark
  fuses nested UDFs of one kind.
* ``Estimator``: fitted by distributed aggregation; ``fit`` gives an operator.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.session import ship_package

Shape = tuple[int, ...]


@dataclass(frozen=True)
class Trials:
    """A frame with one row a trial, and the shapes of its tensor columns.

    ``moved`` names, for columns that hold elements of another column at static positions, that column and the positions;
    ``computed`` are the columns that Catalyst expressions make.
    """

    df: DataFrame
    shapes: Mapping[str, Shape]
    id: str = "trial_id"
    label: str | None = "label"
    moved: Mapping[str, tuple[str, np.ndarray]] = field(default_factory=dict)
    computed: frozenset[str] = frozenset()

    def shape(self, name: str) -> Shape:
        if name not in self.shapes:
            raise KeyError(f"no tensor column {name}; there are {sorted(self.shapes)}")
        return tuple(self.shapes[name])

    def with_column(self, name: str, column: Column, shape: Shape, moved: tuple[str, np.ndarray] | None = None, computed: bool = True) -> Trials:
        known = {k: m for k, m in self.moved.items() if name not in (k, m[0])}
        if moved is not None and moved[0] != name:
            known[name] = moved
        made = self.computed | {name} if computed else self.computed - {name}
        return replace(self, df=self.df.withColumn(name, column), shapes={**self.shapes, name: tuple(shape)}, moved=known, computed=made)

    def with_df(self, df: DataFrame) -> Trials:
        return replace(self, df=df, moved={})


def size_of(shape: Shape) -> int:
    return math.prod(shape)


def norm_axis(axis: int, rank: int) -> int:
    """``axis`` counted from the front."""
    if not -rank <= axis < rank:
        raise ValueError(f"axis {axis} doesn't exist in a tensor of rank {rank}")
    return axis % rank


def tensors(array: pa.Array, shape: Shape) -> np.ndarray:
    """(n, *shape) doubles of a batch without nulls."""
    flat = array if shape == () else array.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(values) != len(array) * size_of(shape):
        raise ValueError(f"a tensor doesn't have the shape {shape}")
    return values.reshape(len(array), *shape)


def as_arrow(values: np.ndarray, shape: Shape) -> pa.Array:
    """A batch of tensors as Arrow doubles or lists of doubles."""
    n = len(values)
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).reshape(-1))
    if shape == ():
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size_of(shape)), flat)


def tensors_of(trials: Trials, name: str, rows: int = 2000) -> Iterator[np.ndarray]:
    """(n, *shape) tensors of all trials by id, as they stream to the driver: at most ``rows`` are held."""
    some, shape = [], trials.shape(name)
    for r in trials.df.filter(F.col(name).isNotNull()).orderBy(trials.id).select(name).toLocalIterator():
        some.append(r[0])
        if len(some) == rows:
            yield np.array(some, float).reshape(len(some), *shape)
            some = []
    if some:
        yield np.array(some, float).reshape(len(some), *shape)


def spark_type(shape: Shape) -> str:
    return "double" if shape == () else "array<double>"


#: Trials that a function of batches sees at once, and bytes that a batch of its results has about, with so many trials at least.
BLOCK_ROWS, BATCH_BYTES, LEAST_ROWS = 500, 8 << 20, 100


def bound_batches(spark: SparkSession, *shapes: Shape) -> None:
    """Make the session's Arrow batches so short that tensors of these shapes keep to ``BATCH_BYTES``; results may be much wider than inputs."""
    rows = max(LEAST_ROWS, BATCH_BYTES // (8 * max(1, *map(size_of, shapes))))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def batch_column(f: Callable[..., np.ndarray], columns: list[Column], shapes: list[Shape], out: Shape, apart: Sequence[Column] = ()) -> Column:
    """``f`` over batches: (n, *shape) arrays in, one (n, *out) array out. Trials with a null input give null.

    Columns in ``apart`` go along as a flag whether they are null. A column that is used twice isn't written out in its
    user's place: Spark (up to 4.1 at least) doesn't find a Python function one of whose arguments holds a lambda
    that uses the variable of a lambda around it, and then fails when it runs.
    """

    def some(*xs: np.ndarray) -> np.ndarray:
        """Block by block: what ``f`` makes in between is as large as a block."""
        n = len(xs[0])
        if n <= BLOCK_ROWS:
            return f(*xs)
        made = np.empty((n, *out))
        for at in range(0, n, BLOCK_ROWS):
            part = [x[at : at + BLOCK_ROWS] for x in xs]
            made[at : at + BLOCK_ROWS] = np.reshape(f(*part), (len(part[0]), *out))
        return made

    def run(*arrays: pa.Array) -> pa.Array:
        arrays = arrays[: len(shapes)]
        good = np.ones(len(arrays[0]), bool)
        for a in arrays:
            if a.null_count:
                good &= a.is_valid().to_numpy(zero_copy_only=False)
        if good.all():
            return as_arrow(some(*(tensors(a, s) for a, s in zip(arrays, shapes))), out) if len(good) else as_arrow(np.empty((0, *out)), out)
        keep = pa.array(good)
        done = as_arrow(some(*(tensors(a.filter(keep), s) for a, s in zip(arrays, shapes))), out) if good.any() else as_arrow(np.empty((0, *out)), out)
        where = np.where(good, np.cumsum(good) - 1, 0)
        return done.take(pa.array(where, mask=~good))

    return F.arrow_udf(run, spark_type(out))(*columns, *(c.isNull() for c in apart))


class Operator:
    """Reads the tensor columns ``inputs`` of each trial and adds the tensor column ``output``."""

    inputs: tuple[str, ...]
    output: str

    def infer(self, *shapes: Shape) -> Shape:
        """The output's shape; ValueError if the inputs don't fit."""
        raise NotImplementedError

    def apply(self, trials: Trials) -> Trials:
        raise NotImplementedError

    def __call__(self, trials: Trials) -> Trials:
        return self.apply(trials)


class ColumnOperator(Operator):
    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        raise NotImplementedError

    def apply(self, trials: Trials) -> Trials:
        shapes = [trials.shape(i) for i in self.inputs]
        return trials.with_column(self.output, self.column([F.col(i) for i in self.inputs], shapes), self.infer(*shapes))


class BatchOperator(Operator):
    def batch(self, *arrays: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def apply(self, trials: Trials) -> Trials:
        ship_package(trials.df.sparkSession)
        out = self.infer(*(trials.shape(i) for i in self.inputs))
        # what was only moved is moved here, by numpy
        sources = [trials.moved.get(i, (i, None)) for i in self.inputs]
        shapes = [trials.shape(name) for name, _ in sources]
        places, batch = [at for _, at in sources], self.batch

        def run(*arrays: np.ndarray) -> np.ndarray:
            return batch(*(a if at is None else a.reshape(len(a), -1)[:, at] for a, at in zip(arrays, places)))

        columns = [F.col(name) for name, _ in sources]
        bound_batches(trials.df.sparkSession, *shapes, out)
        made = batch_column(run, columns, shapes, out, [c for c, (name, _) in zip(columns, sources) if name in trials.computed])
        return trials.with_column(self.output, made, out, computed=False)


class Estimator:
    """Learns from trials; ``fit`` gives the operator that ``inputs`` and ``output`` describe."""

    inputs: tuple[str, ...]
    output: str

    def infer(self, *shapes: Shape) -> Shape:
        raise NotImplementedError

    def fit(self, trials: Trials) -> Operator:
        raise NotImplementedError


def element_sums(df: DataFrame, keys: list[str], vector: str, count: str | None = None) -> list[dict]:
    """Sum of the arrays in ``vector`` for each key: [{key..., count, sum}]; what comes back is one array a key."""
    aggregates = [F.sum("_v").alias("_s")] + ([F.sum(count).alias("_n")] if count else [])
    rows = df.select(*keys, *([count] if count else []), F.posexplode_outer(vector).alias("_i", "_v")).filter("_i is not null").groupBy(*keys, "_i").agg(*aggregates).collect()
    out: dict[tuple, dict] = {}
    for r in rows:
        group = out.setdefault(tuple(r[k] for k in keys), {"at": [], "sum": []} | {k: r[k] for k in keys} | ({"count": r["_n"]} if count else {}))
        group["at"].append(r["_i"])
        group["sum"].append(r["_s"])
    for group in out.values():
        group["sum"] = np.array(group["sum"])[np.argsort(group.pop("at"))]
    return [out[k] for k in sorted(out, key=lambda k: tuple((x is None, x) for x in k))]


#: Trials that a function for sums sees at once.
SUMMED = 1000


def partial_sums(trials: Trials, column: str, f: Callable[..., np.ndarray], by_label: bool, with_labels: bool = False, summed: bool = False,
                 keep: Callable[[np.ndarray], np.ndarray] | None = None) -> list[dict]:
    """Sum over trials of f(tensors) (one vector a trial) for each label or over all: [{label, count, sum}].

    ``with_labels`` calls f(tensors, labels); ``summed`` takes f's result as the sum over its trials already; trials for which
    ``keep`` gives False are left out. Each partition hands on one vector a label, whatever its number of trials.
    """
    ship_package(trials.df.sparkSession)
    shape = trials.shape(column)
    label = F.col(trials.label).cast("double") if by_label or with_labels else F.lit(0.0)

    def run(batches):
        held: dict[float, list] = {}
        for batch in batches:
            known = batch.filter(batch.column(1).is_valid())
            for at in range(0, known.num_rows, SUMMED):
                some = known.slice(at, SUMMED)
                labels, x = some.column(0).to_numpy(zero_copy_only=False), tensors(some.column(1), shape)
                if keep is not None:
                    good = keep(x)
                    labels, x = labels[good], x[good]
                for c in np.unique(labels) if by_label else [0.0] * (len(labels) > 0):
                    own = labels == c if by_label else np.ones(len(labels), bool)
                    total = f(x[own], labels[own]) if with_labels else f(x[own])
                    total = total if summed else total.sum(axis=0)
                    if c in held:
                        held[c][0] += int(own.sum())
                        held[c][1] += total
                    else:
                        held[c] = [int(own.sum()), np.array(total, float)]
        for c, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([float(c)]), pa.array([n], pa.int64()), as_arrow(total[None], total.shape)], names=["_label", "_count", "_sum"])

    rows = trials.df.select(label.alias("_label"), F.col(column)).filter("_label is not null").mapInArrow(run, "_label double, _count long, _sum array<double>")
    return [{"label": g["_label"], "count": g["count"], "sum": g["sum"]} for g in element_sums(rows, ["_label"], "_sum", "_count")]


@dataclass
class Moments:
    """Count, mean and centred sums of rows: products of all pairs of columns, or squares of each. Those of parts merge without cancellation
    (Chan, Golub & LeVeque 1983), however far the rows lie from zero."""

    count: int
    mean: np.ndarray
    centred: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, products: bool) -> Moments:
        mean = x.mean(axis=0)
        c = x - mean
        return cls(len(x), mean, c.T @ c if products else (c * c).sum(axis=0))

    def merged(self, other: Moments) -> Moments:
        n, apart = self.count + other.count, other.mean - self.mean
        between = np.outer(apart, apart) if self.centred.ndim == 2 else apart * apart
        return Moments(n, self.mean + apart * (other.count / n), self.centred + other.centred + between * (self.count * other.count / n))

    @property
    def covariance(self) -> np.ndarray:
        """Divided by the count."""
        return self.centred / self.count


def merge_all(some: Iterable[Moments]) -> Moments:
    return functools.reduce(Moments.merged, some)


#: Tasks that merge the moments of all partitions.
MERGERS = 8


def moments_by(trials: Trials, column: str, keys: Sequence[Column], products: bool, rows: Callable[[np.ndarray], np.ndarray] = lambda x: x.reshape(len(x), -1),
               then: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[tuple, Moments]:
    """``Moments`` of ``rows(tensors)`` for each combination of ``keys`` (numbers; rows with a null one are left out), in one pass.

    Partitions hand on one state a key, which ``MERGERS`` tasks merge: the driver gets one state of each of these.
    With ``then``, a state has beside it those of ``then(tensors)``, squares only, under (*key, "then").
    """
    ship_package(trials.df.sparkSession)
    shape, width = trials.shape(column), len(keys)
    names = [f"_k{i}" for i in range(width)]

    def run(batches):
        held: dict[tuple, Moments] = {}

        def add(key: tuple, part: Moments) -> None:
            held[key] = held[key].merged(part) if key in held else part

        for batch in batches:
            good = batch.column(width).is_valid()
            for i in range(width):
                good = pc.and_(good, batch.column(i).is_valid())
            known = batch.filter(good)
            for at in range(0, known.num_rows, SUMMED):
                some = known.slice(at, SUMMED)
                marks = np.stack([some.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1) if width else np.zeros((some.num_rows, 0))
                x = tensors(some.column(width), shape)
                for key in sorted(set(map(tuple, marks.tolist()))):
                    own = x[(marks == key).all(axis=1)]
                    if len(part := rows(own)):
                        add(key, Moments.of(part, products))
                    if then is not None:
                        add((*key, "then"), Moments.of(then(own), False))
        yield from packed(held)

    def packed(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["state"])

    def both(a: dict, b: dict) -> dict:
        return {k: a[k].merged(b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}

    def merge(batches):
        yield from packed(functools.reduce(both, (pickle.loads(state.as_py()) for batch in batches for state in batch.column(0)), {}))

    # a merge by an RDD's functions would keep a second Python process beside each one of this pass
    states = trials.df.select(*(k.cast("double").alias(n) for k, n in zip(keys, names)), F.col(column)).mapInArrow(run, "state binary")
    found = functools.reduce(both, (pickle.loads(r[0]) for r in states.repartition(MERGERS).mapInArrow(merge, "state binary").collect()), {})
    return dict(sorted(found.items(), key=str))


@contextmanager
def cached(trials: Trials, column: str, label: Column | None = None) -> Iterator[Trials]:
    """Labels and one tensor column of trials, held by the executors (in memory or on their disks) for several passes.

    What a lost executor held is made again from the trials. The column is named _c, the label _y.
    """
    some = trials.df.select(trials.id, (F.lit(0.0) if label is None else label).cast("double").alias("_y"), F.col(column).alias("_c"))
    held = some.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # a filter below the held rows would run the column's Python functions twice, in two processes a task
        yield Trials(held.filter("_c is not null"), {"_c": trials.shape(column)}, trials.id, "_y")
    finally:
        held.unpersist()


def sample_of(trials: Trials, column: str, doubles: int, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tensors, labels) on the driver of the trials with the least hashes of their ids, about ``doubles`` numbers; all where they are fewer."""
    rows = trials.df.filter(F.col(column).isNotNull() & F.col(trials.label).isNotNull())
    shape = trials.shape(column)
    share = doubles / max(1, size_of(shape)) / max(1, rows.count() if total is None else total)
    if share < 1:
        rows = rows.filter(F.xxhash64(F.col(trials.id).cast("string")) < int(-(2**63) + share * 2**64))
    found = rows.orderBy(trials.id).select(column, F.col(trials.label).cast("double")).collect()
    return np.array([r[0] for r in found], float).reshape(len(found), *shape), np.array([r[1] for r in found])
