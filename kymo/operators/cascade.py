"""Support vector machines over all trials: a cascade of support vectors, checked to its end on every trial, or a decomposition.

Executors fit machines on blocks of trials and keep the support (Graf et al. 2004). Where that is few, it is dealt into blocks again, until it
settles; the driver fits on what remains, and every trial that isn't among it is held against the result: trials inside the
margin join the support, the machine is fitted again, and so on until no trial of the table is inside the margin by more than the tolerance. The result
thus meets the conditions of the optimum on all trials, as a machine fitted on all at once does.

Where most trials are support (classes that overlap), there is little to fit on the driver alone. The blocks' multipliers are then a start for
all trials, and a decomposition (Osuna, Freund & Girosi 1997; working sets of many rows as in Zanni, Serafini & Zanghirati 2006) goes on from it: every trial keeps its
multipliers and gradients in a table; a round takes the trials of each pair that violate the conditions most, tasks solve these
small problems, and one pass moves all gradients. It ends where no two trials of a pair violate the conditions by the tolerance, as one machine fitted on all trials does.
Its time grows with the square of the support, like any exact machine's.

The model is the support, each trial once for all pairs, which scoring needs as well. A large one is a file that Spark hands to every executor and of which
a task has a tile in hand at once (``Filed``), so neither driver nor tasks hold it. An SVM whose support passes ``most`` numbers is an error that says so; nothing is sampled.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymo.numerics import learn
from kymo.operators.base import Trials, as_arrow, cached, moments_by, partial_sums, size_of, tensors
from kymo.session import remove_path, ship_package, shared_path, stored

#: Trials of a block that an executor fits at once.
BLOCK = 1024
#: Trials of a pair that join its support in a round of the check at most: those deepest inside the margin; the others come in later rounds.
WORST = 256
#: Rounds at most: of the check, and of a decomposition for each working set that the trials would fill.
ROUNDS = 1000

#: Trials that a task has in hand at once in a decomposition.
ROWS = 4096
#: Trials of a pair's working set, from either end.
WORKING = 1024
#: The cascade ends on the driver where its support is no more than this part of ``most``; the model of a decomposition is held in memory up to there.
SHARE = 16

SUPPORT = "pair int, id string, sign double, x array<double>"
STATE = "id string, c int, x array<double>, alpha array<double>, gradient array<double>"


def _signed(svm: learn.Svm, y: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places of a pair's trials, their signs)."""
    at = np.flatnonzero((y == svm.classes[pair[0]]) | (y == svm.classes[pair[1]]))
    return at, np.where(y[at] == svm.classes[pair[0]], 1.0, -1.0)


def _rows(pair: int, ids: list, sign: np.ndarray, x: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([pair] * len(ids), pa.int32()), pa.array(ids, pa.string()), pa.array(sign), as_arrow(x, (x.shape[1],))]
    return pa.RecordBatch.from_arrays([*columns, *map(pa.array, more.values())], names=["pair", "id", "sign", "x", *more])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.Table]:
    """Batches together until they have so many rows."""
    some, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            some.append(part)
            n += part.num_rows
            if n >= rows:
                yield pa.Table.from_batches(some).combine_chunks()
                some, n = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def _both(svm: learn.Svm, x: np.ndarray, sign: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    """Places of the support; where a block has one class only, all of it stays."""
    if len(np.unique(sign)) < 2:
        return np.arange(len(sign))
    return svm.machine(pair, x, sign)[3]


def fit(trials: Trials, column: str, svm: learn.Svm, most: int) -> np.ndarray:
    """Fit ``svm`` on all labelled trials; its classes."""
    ship_package(trials.df.sparkSession)
    size, shape = size_of(trials.shape(column)), trials.shape(column)
    numbers = trials.df.filter(F.col(column).isNotNull() & F.col(trials.label).isNotNull())
    # written once: the check goes over it in every round
    held = stored(numbers.select(F.col(trials.id).cast("string").alias("id"), F.col(trials.label).cast("double").alias("y"), F.col(column).alias("x")), "svm")
    counted = held.groupBy("y").count().orderBy("y").collect()
    all_ = Trials(held, {"x": shape}, "id", "y")
    variance = moments_by(all_, "x", [], False, lambda x: x.reshape(-1, 1))[()].covariance[0]
    svm.prepare(np.array([r["y"] for r in counted]), np.array([r["count"] for r in counted]), size, float(variance))
    pairs = svm.pairs()
    started, n = _started(held, svm, shape, sum(r["count"] for r in counted))
    if n * size > most // SHARE and 2 * n > sum(r["count"] for r in counted) * (len(counted) - 1):
        return _decomposed(started, svm, shape, most)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come pair by pair."""
        for t in _blocks(batches):
            x, number, sign = tensors(t.column("x").chunk(0), (size,)), t.column("pair").to_numpy(), t.column("sign").to_numpy()
            for n in np.unique(number).tolist():
                own = np.flatnonzero(number == n)
                keep = own[_both(svm, x[own], sign[own], pairs[n])]
                yield _rows(n, t.column("id").take(pa.array(keep)).to_pylist(), sign[keep], x[keep])

    numbered = {p: i for i, p in enumerate(pairs)}
    places = F.array(*[F.array(*[F.lit(numbered.get((min(c, o), max(c, o)), -1)) for o in range(len(svm.classes))]) for c in range(len(svm.classes))])
    each = started.select("id", "c", "x", F.posexplode("alpha").alias("o", "a")).filter("a <> 0").withColumn("o", F.expr("o + int(o >= c)"))
    support = stored(each.select(F.get(F.get(places, "c"), "o").alias("pair"), "id", F.when(F.expr("c < o"), 1.0).otherwise(-1.0).alias("sign"), "x").sortWithinPartitions("pair"), "support")
    while n > max(BLOCK, most // (4 * size)):  # dealt into other blocks, less may stay
        parts = max(1, n // (4 * BLOCK))
        support = stored(support.repartition(parts, F.xxhash64("id", F.lit(n)) % (8 * parts)).sortWithinPartitions("pair").mapInArrow(again, SUPPORT), "support")
        before, n = n, support.count()
        if n > 0.8 * before:
            break
    if n * size > most // SHARE:
        return _decomposed(started, svm, shape, most)
    working: list[dict[str, tuple[float, np.ndarray]]] = [{} for _ in pairs]
    for r in support.collect():
        working[r["pair"]][r["id"]] = (r["sign"], np.array(r["x"], float))
    _checked(held, shape, svm, pairs, working, most)
    if svm.probability:
        _sigmoids(all_, svm, pairs)
    return svm.classes


def _checked(held, shape, svm: learn.Svm, pairs: list, working: list[dict], most: int) -> None:
    """Fit on the working sets, add the trials of the table that the machines put inside the margin, until there are none."""
    spark, open_ = held.sparkSession, set(range(len(pairs)))
    svm.machines = [None] * len(pairs)
    for _ in range(ROUNDS):
        for n in open_:
            ids = list(working[n])
            x, sign = np.stack([working[n][i][1] for i in ids]), np.array([working[n][i][0] for i in ids])
            part, weight, bias, at = svm.machine(pairs[n], x, sign, most)
            svm.machines[n] = (*pairs[n], part, weight, bias)
            working[n] = {ids[i]: working[n][ids[i]] for i in at}  # what isn't support may come back by the check
        if sum(map(len, working)) * part.shape[1] > most:
            raise MemoryError(f"the machines have {sum(map(len, working))} support vectors, more than {most} numbers")
        shared = spark.sparkContext.broadcast((svm, sorted(open_), [frozenset(w) for w in working]))

        def violators(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine, numbers, known = shared.value
            worst: dict[int, list] = {n: [] for n in numbers}
            for t in _blocks(batches):
                x, y, ids = tensors(t.column("x").chunk(0), shape).reshape(t.num_rows, -1), t.column("y").to_numpy(), t.column("id").to_pylist()
                for n in numbers:
                    at, sign = _signed(machine, y, pairs[n])
                    if len(at):
                        inside = 1 - machine.tol - sign * machine.margins(x[at], n)
                        found = [(float(inside[i]), ids[at[i]], float(sign[i]), x[at[i]]) for i in np.flatnonzero(inside > 0) if ids[at[i]] not in known[n]]
                        worst[n] = sorted(worst[n] + found, key=lambda v: (-v[0], v[1]))[:WORST]
            for n, some in worst.items():
                if some:
                    yield _rows(n, [v[1] for v in some], np.array([v[2] for v in some]), np.stack([v[3] for v in some]), inside=np.array([v[0] for v in some]))

        deepest = Window.partitionBy("pair").orderBy(F.desc("inside"), "id")
        found = held.mapInArrow(violators, SUPPORT + ", inside double").withColumn("rank", F.row_number().over(deepest)).filter(F.col("rank") <= WORST).collect()
        shared.destroy()
        open_ = {r["pair"] for r in found}
        for r in found:
            working[r["pair"]][r["id"]] = (r["sign"], np.array(r["x"], float))
        if not open_:
            return
    raise ArithmeticError(f"after {ROUNDS} rounds trials are still inside the margin")


def _started(held: DataFrame, svm: learn.Svm, shape: tuple, count: int) -> tuple[DataFrame, int]:
    """(trials dealt by their ids, with the multipliers of their own block's machines against each other class; how many of these aren't zero).

    A multiplier of -1 says that a block had one class of the pair only.
    """
    pairs, block, rows, k = svm.pairs(), BLOCK, ROWS, len(svm.classes)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, rows):
            x, c = tensors(t.column("x").chunk(0), shape).reshape(t.num_rows, -1), t.column("c").to_numpy()
            alpha = np.zeros((len(c), k - 1))
            for i, j in pairs:
                at, sign, column = _of_pair(c, i, j)
                parts = -(-len(at) // block)
                for part in range(parts):
                    own = slice(part, None, parts)
                    if len(np.unique(sign[own])) < 2:
                        alpha[at[own], column[own]] = -1.0
                        continue
                    some, most = x[at[own]], np.where(sign[own] > 0, svm.most[i], svm.most[j])
                    alpha[at[own], column[own]] = svm.resolved(svm.gram(some, some), sign[own], most, np.zeros(len(some)), -np.ones(len(some)))
            yield _state(t, alpha, np.zeros((len(c), 0)))

    parts = max(-(-count // ROWS), min(held.sparkSession.sparkContext.defaultParallelism, count // BLOCK))
    place = (F.array_position(F.lit(svm.classes.tolist()), F.col("y")) - 1).cast("int").alias("c")
    dealt = held.select("id", place, "x").repartition(max(1, parts), F.xxhash64("id"))
    started = stored(dealt.mapInArrow(start, STATE), "started")
    return started, started.select(F.sum(F.size(F.filter("alpha", lambda a: a != 0)))).first()[0] or 0


def _of_pair(c: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of a pair's trials among some, their signs, the columns of their multipliers)."""
    at = np.flatnonzero((c == i) | (c == j))
    first = c[at] == i
    return at, np.where(first, 1.0, -1.0), np.where(first, j - 1, i)


def _state(t: pa.Table, alpha: np.ndarray, gradient: np.ndarray) -> pa.RecordBatch:
    columns = [*(t.column(n).chunk(0) for n in ("id", "c", "x")), as_arrow(alpha, alpha.shape[1:]), as_arrow(gradient, gradient.shape[1:])]
    return pa.RecordBatch.from_arrays(columns, names=["id", "c", "x", "alpha", "gradient"])


class Filed(learn.Machines):
    """Machines whose vectors, each with its multipliers times signs, lie class by class in a file of the Spark session; a tile of them is in hand at once."""

    def __init__(self, name: str, counts: list[int], size: int, biases: np.ndarray):
        self.name, self.counts, self.size = name, counts, size
        self._paired(len(counts), biases)

    def tiles(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = self.size + self.classes - 1
        with open(SparkFiles.get(self.name), "rb") as f:
            f.seek(8 * width * sum(self.counts[:c]))
            for k in range(0, self.counts[c], learn.TILE):
                rows = min(learn.TILE, self.counts[c] - k)
                t = np.fromfile(f, np.float64, rows * width).reshape(rows, width)
                yield t[:, : self.size], t[:, self.size :]


def _model(state: DataFrame, svm: learn.Svm, size: int, most: int, biases: np.ndarray) -> learn.Machines:
    """The machines of a table's multipliers, read class by class; beyond a part of ``most`` numbers they come in parts and go to a file."""
    spark, others = state.sparkSession, len(svm.classes) - 1
    some = state.withColumn("alpha", F.transform("alpha", lambda a: F.greatest(a, F.lit(0.0)))).filter(F.exists("alpha", lambda a: a > 0))
    counted = {r["c"]: r["count"] for r in some.groupBy("c").count().collect()}
    counts, hold = [counted.get(c, 0) for c in range(others + 1)], max(1, most // SHARE)
    numbers = sum(counts) * (size + others)
    if numbers > most:
        raise MemoryError(f"the machines have {sum(counts)} support vectors of {size} numbers and {others} multipliers, more than {most} numbers")

    def read(c: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
        own = some.filter((F.col("c") == c) & (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(parts)) == part))
        t = own.select("x", "alpha").toArrow().combine_chunks()
        columns = [t.column(n).chunk(0) if t.num_rows else pa.array([], pa.list_(pa.float64())) for n in ("x", "alpha")]
        return tensors(columns[0], (size,)), tensors(columns[1], (others,)) * np.where(np.arange(others) >= c, 1.0, -1.0)

    if numbers <= hold:
        return learn.Machines(*map(list, zip(*map(read, range(others + 1)))), biases)
    folder = tempfile.mkdtemp(prefix="kymo-svm-")
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder) / f"svm-{uuid.uuid4().hex}"
    with path.open("wb") as f:
        for c in range(others + 1):
            parts = -(-counts[c] * (size + others) // hold)
            for part in range(parts):
                np.hstack(read(c, part, parts)).tofile(f)
    if path.stat().st_size != 8 * numbers:
        raise ValueError("the support changed while it was read")
    spark.sparkContext.addFile(str(path))
    return Filed(path.name, counts, size, biases)


def _arrays(t: pa.Table, shape: tuple, others: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, classes, multipliers, gradients) of some rows of a state."""
    x = tensors(t.column("x").chunk(0), shape).reshape(t.num_rows, -1) if "x" in t.column_names else None
    return x, t.column("c").to_numpy(), *(tensors(t.column(n).chunk(0), (others,)) for n in ("alpha", "gradient"))


def _sides(svm: learn.Svm, pair: tuple[int, int], sign: np.ndarray, alpha: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(-sign * gradient, where a multiplier times its sign may grow, where it may fall)."""
    most = np.where(sign > 0, svm.most[pair[0]], svm.most[pair[1]])
    up, low = (alpha < most) & (sign > 0) | (alpha > 0) & (sign < 0), (alpha < most) & (sign < 0) | (alpha > 0) & (sign > 0)
    return -sign * gradient, up, low


def _decomposed(started: DataFrame, svm: learn.Svm, shape: tuple, most: int) -> np.ndarray:
    """Go on from the blocks' multipliers to the optimum on all trials; the classes."""
    spark, pairs, size, others = started.sparkSession, svm.pairs(), size_of(shape), len(svm.classes) - 1
    working = int(max(16, min(WORKING, most // (SHARE * len(pairs) * size))))
    path = None

    def step(df: DataFrame, run) -> DataFrame:
        """The next state, written; the one before goes."""
        nonlocal path
        before, path = path, shared_path(spark, "svm-state")
        df.select("id", "c", "x", "alpha", "gradient").mapInArrow(run, STATE).write.parquet(path)
        if before:
            remove_path(spark, before)
        return spark.read.schema(STATE).parquet(path)

    shared = spark.sparkContext.broadcast(_model(started, svm, size, most, np.zeros(len(pairs))))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, ROWS):
            c = t.column("c").to_numpy()
            margins = shared.value.margins(tensors(t.column("x").chunk(0), shape).reshape(t.num_rows, -1), svm.gram)
            gradient = np.zeros((t.num_rows, others))
            for n, (i, j) in enumerate(pairs):
                at, sign, column = _of_pair(c, i, j)
                gradient[at, column] = sign * margins[at, n] - 1
            yield _state(t, np.maximum(0.0, tensors(t.column("alpha").chunk(0), (others,))), gradient)

    state = step(started, begin)
    shared.destroy()
    rounds = ROUNDS * -(-state.count() // working)
    for _ in range(rounds):
        tops, lows, gaps = _ends(state, svm, working)
        open_ = [n for n in range(len(pairs)) if gaps[n] >= svm.tol]
        if not open_:
            break
        changes = _solved(state, svm, shape, open_, tops, lows, working)
        shared = spark.sparkContext.broadcast(changes)

        def move(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for t in _blocks(batches, ROWS):
                x, c, alpha, gradient = _arrays(t, shape, others)
                alpha, gradient, ids = alpha.copy(), gradient.copy(), t.column("id").to_pylist()
                for n, (known, vectors, moved) in shared.value.items():
                    at, sign, column = _of_pair(c, *pairs[n])
                    for k in range(0, len(at), learn.TILE):
                        some = slice(k, k + learn.TILE)
                        gradient[at[some], column[some]] += sign[some] * (svm.gram(x[at[some]], vectors) @ moved)
                    for p, col in zip(at.tolist(), column.tolist()):
                        if (a := known.get(ids[p])) is not None:
                            alpha[p, col] = a
                yield _state(t, alpha, gradient)

        state = step(state, move)
        shared.destroy()
    else:
        raise ArithmeticError(f"after {rounds} rounds trials are still inside the margin")
    biases = _biases(state, svm, [(a + b) / 2 for a, b in zip(tops.best, lows.best)])
    svm.machines = _model(state, svm, size, most, biases)
    if svm.probability:
        counts = {r["c"]: r["count"] for r in state.groupBy("c").count().collect()}

        def margins(gradient: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            at, sign, column = _of_pair(c, *pairs[n])
            return sign * (gradient[at, column] + 1) + biases[n], sign

        _flowed(Trials(state.withColumn("c", F.col("c").cast("double")), {"gradient": (others,)}, "id", "c"), "gradient", svm, [(counts[i], counts[j]) for i, j in pairs], margins)
    remove_path(spark, path)
    return svm.classes


class _Ends:
    """Of each pair, the best value of a side and the one from which a working set takes trials."""

    def __init__(self, best: list[float], bound: list[float]):
        self.best, self.bound = best, bound


def _ends(state: DataFrame, svm: learn.Svm, working: int) -> tuple[_Ends, _Ends, list[float]]:
    """(where multipliers times signs may grow, where they may fall, how far each pair is from the conditions), from every some-th of a partition's first values."""
    pairs, others = svm.pairs(), len(svm.classes) - 1
    every = max(1, working // (4 * max(1, state.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for t in _blocks(batches, ROWS):
            _, c, alpha, gradient = _arrays(t, (), others)
            for n, pair in enumerate(pairs):
                at, sign, column = _of_pair(c, *pair)
                v, up, low = _sides(svm, pair, sign, alpha[at, column], gradient[at, column])
                for side, some in ((0, -v[up]), (1, v[low])):  # the least ones count
                    held[n, side] = np.sort(np.concatenate([held.get((n, side), np.empty(0)), some]))[: working + 1]
        if held:
            keys = list(held)
            values = [held[k][::every] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["pair", "side", "v"])

    found = state.select("c", "alpha", "gradient").mapInArrow(run, "pair int, side int, v array<double>").toArrow()
    sides: dict[tuple[int, int], list] = {}
    for n, side, v in zip(*(found.column(i).to_pylist() for i in range(3))):
        sides.setdefault((n, side), []).append(v)
    merged = {k: np.sort(np.concatenate(v)) for k, v in sides.items()}
    best = [[float(merged[n, s][0]) if len(merged[n, s]) else np.inf for n in range(len(pairs))] for s in (0, 1)]
    bound = [[float(merged[n, s][working // every]) if len(merged[n, s]) > working // every else np.inf for n in range(len(pairs))] for s in (0, 1)]
    tops, lows = _Ends([-b for b in best[0]], [-b for b in bound[0]]), _Ends(best[1], bound[1])
    return tops, lows, [a - b for a, b in zip(tops.best, lows.best)]


def _solved(state: DataFrame, svm: learn.Svm, shape: tuple, open_: list[int], tops: _Ends, lows: _Ends, working: int) -> dict[int, tuple[dict, np.ndarray, np.ndarray]]:
    """Of each open pair: the new multipliers of its working set by id, the vectors of those that changed, and by how much times their signs. A task solves a pair's."""
    pairs, others = svm.pairs(), len(svm.classes) - 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, ROWS):
            x, c, alpha, gradient = _arrays(t, shape, others)
            for n in open_:
                at, sign, column = _of_pair(c, *pairs[n])
                a, g = alpha[at, column], gradient[at, column]
                v, up, low = _sides(svm, pairs[n], sign, a, g)
                places = [np.flatnonzero(ok)[np.argsort(w[ok], kind="stable")[:working]] for ok, w in ((up & (v >= tops.bound[n]), -v), (low & (v <= lows.bound[n]), v))]
                keep = np.union1d(*places)
                if len(keep):
                    yield _rows(n, t.column("id").take(pa.array(at[keep])).to_pylist(), sign[keep], x[at[keep]], alpha=a[keep], gradient=g[keep])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        n, sign = t.column("pair")[0].as_py(), t.column("sign").to_numpy()
        x, a, g = tensors(t.column("x").chunk(0), (size_of(shape),)), t.column("alpha").to_numpy(), t.column("gradient").to_numpy()
        v, up, low = _sides(svm, pairs[n], sign, a, g)
        w = np.union1d(*[np.flatnonzero(ok)[np.argsort(s[ok], kind="stable")[:working]] for ok, s in ((up, -v), (low, v))])
        most = np.where(sign[w] > 0, svm.most[pairs[n][0]], svm.most[pairs[n][1]])
        new = svm.resolved(svm.gram(x[w], x[w]), sign[w], most, a[w], g[w])
        at = np.flatnonzero(new != a[w])
        some = _rows(n, t.column("id").take(pa.array(w[at])).to_pylist(), sign[w[at]], x[w[at]], alpha=new[at], moved=((new - a[w]) * sign[w])[at])
        return pa.Table.from_batches([some])

    picked = state.mapInArrow(pick, SUPPORT + ", alpha double, gradient double")
    found = picked.repartition(4 * len(open_), "pair").groupBy("pair").applyInArrow(solve, SUPPORT + ", alpha double, moved double").toArrow().combine_chunks()
    if not found.num_rows:
        raise ArithmeticError("no working set moves, though trials are inside the margin")
    pair, ids, x = found.column("pair").to_numpy(), found.column("id").to_pylist(), tensors(found.column("x").chunk(0), (size_of(shape),))
    alpha, moved, out = found.column("alpha").to_numpy(), found.column("moved").to_numpy(), {}
    for n in np.unique(pair).tolist():
        at = np.flatnonzero(pair == n)
        out[n] = {ids[i]: float(alpha[i]) for i in at}, x[at], moved[at]
    return out


def _biases(state: DataFrame, svm: learn.Svm, between: list[float]) -> np.ndarray:
    """Of each pair the mean of what trials with a free multiplier say, or the middle of both sides where there are none."""
    pairs, others = svm.pairs(), len(svm.classes) - 1

    def sums(both: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros((len(pairs), 2))
        for n, (i, j) in enumerate(pairs):
            at, sign, column = _of_pair(c, i, j)
            a, g = both[at, column], both[at, others + column]
            free = (a > 1e-9) & (a < np.where(sign > 0, svm.most[i], svm.most[j]) - 1e-9)
            out[n] = -(sign * g)[free].sum(), free.sum()
        return out.ravel()

    both = state.select("id", F.col("c").cast("double").alias("c"), F.concat("alpha", "gradient").alias("both"))
    found = partial_sums(Trials(both, {"both": (2 * others,)}, "id", "c"), "both", sums, False, with_labels=True, summed=True)[0]["sum"].reshape(-1, 2)
    return np.where(found[:, 1] > 0, found[:, 0] / np.maximum(1, found[:, 1]), between)


def _sigmoids(all_: Trials, svm: learn.Svm, pairs: list) -> None:
    """Sigmoids of all machines over all trials."""

    def margins(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, sign = _signed(svm, y, pairs[n])
        return svm.margins(x.reshape(len(x), -1)[at], n), sign

    with cached(all_, "x", F.col("y")) as held:
        counts = {r["_y"]: r["count"] for r in held.df.groupBy("_y").count().collect()}
        _flowed(held, "_c", svm, [(counts[svm.classes[i]], counts[svm.classes[j]]) for i, j in pairs], margins)


def _flowed(held: Trials, column: str, svm: learn.Svm, counted: list[tuple[int, int]], margins: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> None:
    """Sigmoids from sums over all trials; pairs share each pass."""

    def sums(asked: dict) -> dict:
        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([learn.sigmoid_sums(*margins(x, y, n), ab, *learn.sigmoid_targets(*counted[n])) for n, ab in asked.items()])

        found = partial_sums(held, column, part, False, with_labels=True, summed=True)[0]["sum"].reshape(-1, 6)
        return dict(zip(list(asked), found))

    fitted = learn.run_flows({n: learn.sigmoid_flow(*c) for n, c in enumerate(counted)}, sums)
    svm.sigmoids = [fitted[n] for n in range(len(counted))]
