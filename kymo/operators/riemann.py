"""Operators on covariance matrices: mean, distance, minimum distance to mean, tangent space, potato, adaptive re-centring.

A mean over trials is found by the Karcher flow over all of them: each of its steps is one pass that sums logs on the
executors and brings one matrix to the driver. The flow starts at the mean of a sample of about ``START_DOUBLES`` numbers,
so a few steps are left, or one where the sample is all there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.numerics import spd
from kymo.operators.base import BatchOperator, Estimator, Operator, Shape, Trials, cached, moments_by, partial_sums, sample_of
from kymo.operators.reduce import Covariance
from kymo.session import ship_package

START_DOUBLES = 400_000


def _square(a: Shape) -> Shape:
    if len(a) != 2 or a[0] != a[1]:
        raise ValueError(f"a covariance matrix is square, not {a}")
    return a


def flowed(held: Trials, starts: dict[float, np.ndarray], transform: Callable[[np.ndarray], np.ndarray], keep: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[float, np.ndarray]:
    """Means of transform(C) by label, from ``starts``; all flows share each pass over the ``cached`` trials."""
    n = held.shape("_c")[0]
    flows = {k: spd.KarcherStep(start) for k, start in starts.items()}
    while open_flows := {k: f for k, f in flows.items() if not f.done}:
        whiteners = {k: f.whitener() for k, f in open_flows.items()}

        def logs(c: np.ndarray, y: np.ndarray, whiteners: dict = whiteners) -> np.ndarray:
            w = whiteners.get(float(y[0]))  # trials come label by label
            return np.zeros(n * n) if w is None else spd.logm(w @ transform(c) @ w).sum(axis=0).ravel()

        for g in partial_sums(held, "_c", logs, True, with_labels=True, summed=True, keep=keep):
            if g["label"] in open_flows:
                open_flows[g["label"]].advance((g["sum"] / g["count"]).reshape(n, n))
    return {k: f.at for k, f in flows.items()}


def starting_points(held: Trials, transform: Callable[[np.ndarray], np.ndarray], most: int) -> dict[float, np.ndarray]:
    """For each label the mean over a sample, or the arithmetic mean where the sample has no trial of it."""
    n = held.shape("_c")[0]
    found = {g["label"]: g for g in partial_sums(held, "_c", lambda c: transform(c).sum(axis=0).ravel(), True, summed=True)}
    c, y = sample_of(held, "_c", most, sum(g["count"] for g in found.values()))
    return {k: spd.mean(transform(c[y == k])) if (y == k).any() else (g["sum"] / g["count"]).reshape(n, n) for k, g in found.items()}


def karcher_means(trials: Trials, column: str, transform: Callable[[np.ndarray], np.ndarray] = lambda c: c, by_label: bool = True, most: int = START_DOUBLES) -> dict[float, np.ndarray]:
    """Mean of transform(C) for each label (or under 0.0 over all trials). ``most`` bounds the sample that flows start from."""
    _square(trials.shape(column))
    with cached(trials, column, F.col(trials.label) if by_label else None) as held:
        held = held.with_df(held.df.filter("_y is not null"))
        return flowed(held, starting_points(held, transform, most), transform)


def karcher_mean(trials: Trials, column: str, transform: Callable[[np.ndarray], np.ndarray] = lambda c: c, most: int = START_DOUBLES) -> np.ndarray:
    """Mean of transform(C) over trials."""
    found = karcher_means(trials, column, transform, False, most)
    if not found:
        raise ValueError("a mean needs one trial")
    return found[0.0]


class RiemannMean(BatchOperator):
    """Frechet mean of each trial's set of matrices, shape (m, n, n), with optional weights of its members."""

    def __init__(self, a: str, output: str, weights: Sequence[float] | None = None):
        self.inputs, self.output, self.weights = (a,), output, weights

    def infer(self, a: Shape) -> Shape:
        if len(a) != 3:
            raise ValueError("the mean takes a set of matrices, rank 3")
        if self.weights is not None and len(self.weights) != a[0]:
            raise ValueError("one weight for each matrix")
        return _square(a[1:])

    def batch(self, a: np.ndarray) -> np.ndarray:
        return np.stack([spd.mean(x, self.weights) for x in a])


class RiemannDistance(BatchOperator):
    """Affine-invariant distances between all matrices of two tensors of a trial; rank 2 is a set of one. Shape (m, n)."""

    def __init__(self, a: str, b: str, output: str):
        self.inputs, self.output = (a, b), output

    def infer(self, a: Shape, b: Shape) -> Shape:
        if _square(a[-2:]) != _square(b[-2:]) or not {len(a), len(b)} <= {2, 3}:
            raise ValueError("both take matrices of one size, rank 2 or 3")
        return (a[0] if len(a) == 3 else 1, b[0] if len(b) == 3 else 1)

    def batch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = (x if x.ndim == 4 else x[:, None] for x in (a, b))
        return spd.distance(a[:, :, None], b[:, None, :])


class DistancesTo(BatchOperator):
    """Distances to fixed matrices (a fitted set, held by every task)."""

    def __init__(self, a: str, output: str, points: np.ndarray, transform: Callable[[np.ndarray], np.ndarray] = lambda c: c):
        self.inputs, self.output, self.points, self.transform = (a,), output, points, transform

    def infer(self, a: Shape) -> Shape:
        _square(a)
        return (len(self.points),)

    def batch(self, a: np.ndarray) -> np.ndarray:
        c = self.transform(a)
        return np.stack([spd.distance(p, c) for p in self.points], axis=1)


class NearestMean(BatchOperator):
    """Label of the nearest class mean."""

    def __init__(self, a: str, output: str, labels: np.ndarray, means: np.ndarray):
        self.inputs, self.output, self.labels, self.means = (a,), output, labels, means

    def infer(self, a: Shape) -> Shape:
        _square(a)
        return ()

    def batch(self, a: np.ndarray) -> np.ndarray:
        d = np.stack([spd.distance(m, a) for m in self.means], axis=1)
        return self.labels[d.argmin(axis=1)]


class RiemannMdm(Estimator):
    """Minimum distance to class means (Barachant et al. 2012)."""

    def __init__(self, a: str, output: str, num_classes: int | None = None):
        self.inputs, self.output, self.num_classes = (a,), output, num_classes

    def infer(self, a: Shape) -> Shape:
        _square(a)
        return ()

    def fit(self, trials: Trials) -> Operator:
        means = karcher_means(trials, self.inputs[0])
        if self.num_classes is not None and len(means) != self.num_classes:
            raise ValueError(f"{len(means)} classes, not {self.num_classes}")
        labels = sorted(means)
        return NearestMean(self.inputs[0], self.output, np.array(labels), np.stack([means[k] for k in labels]))


class ToTangent(BatchOperator):
    """Tangent vectors at a reference, of (1 - r) C + r I."""

    def __init__(self, a: str, output: str, reference: np.ndarray, r: float = 0.0):
        self.inputs, self.output, self.reference, self.r = (a,), output, reference, r

    def infer(self, a: Shape) -> Shape:
        n = _square(a)[0]
        return (n * (n + 1) // 2,)

    def batch(self, a: np.ndarray) -> np.ndarray:
        return spd.tangent(spd.regularise(a, self.r), self.reference)


METRICS = ("riemann", "euclid", "logeuclid")


class TangentSpace(Estimator):
    """Projection to the tangent space at the mean of the training matrices, by ``metric``.

    ``weights`` names a column of trials' weights. ``tsupdate`` takes the mean of the trials that are projected instead.
    """

    def __init__(self, a: str, output: str, regularization: float = 0.0, metric: str = "riemann", tsupdate: bool = False, weights: str | None = None):
        if metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}")
        self.inputs, self.output, self.r, self.metric, self.tsupdate, self.weights = (a,), output, regularization, metric, tsupdate, weights

    def infer(self, a: Shape) -> Shape:
        n = _square(a)[0]
        return (n * (n + 1) // 2,)

    def reference(self, trials: Trials) -> np.ndarray:
        a, r = self.inputs[0], self.r
        regular = lambda c: spd.regularise(c, r)
        if self.weights is None and self.metric == "riemann":
            return karcher_mean(trials, a, regular)
        with cached(trials, a, F.lit(1.0) if self.weights is None else F.col(self.weights)) as held:
            if self.metric == "riemann":
                return weighted(held, regular)
            flat = lambda x: regular(x) if self.metric == "euclid" else spd.logm(regular(x))
            mean = weighted_sum(held, flat)
        return mean if self.metric == "euclid" else spd.expm(mean)

    def fit(self, trials: Trials) -> Operator:
        if self.tsupdate:
            return FollowingTangent(self)
        return ToTangent(self.inputs[0], self.output, self.reference(trials), self.r)


def weighted_sum(held: Trials, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean of f(C) over ``cached`` trials, weighted by their labels."""
    n = held.shape("_c")[0]

    def sums(c: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.append(np.einsum("t,tij->ij", w, f(c)).ravel(), w.sum())

    found = partial_sums(held, "_c", sums, False, with_labels=True, summed=True)
    if not found or found[0]["sum"][-1] <= 0:
        raise ValueError("a mean needs trials with weight")
    return (found[0]["sum"][:-1] / found[0]["sum"][-1]).reshape(n, n)


def weighted(held: Trials, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted Riemannian mean of ``cached`` trials, by the Karcher flow from their weighted arithmetic mean."""
    flow = spd.KarcherStep(weighted_sum(held, transform))
    while not flow.done:
        w = flow.whitener()
        flow.advance(weighted_sum(held, lambda c, w=w: spd.logm(w @ transform(c) @ w)))
    return flow.at


class FollowingTangent(Operator):
    """Tangent vectors at the mean of the very trials that are projected."""

    def __init__(self, space: TangentSpace):
        self.inputs, self.output, self.space = space.inputs, space.output, space

    def infer(self, a: Shape) -> Shape:
        return self.space.infer(a)

    def apply(self, trials: Trials) -> Trials:
        return ToTangent(self.inputs[0], self.output, self.space.reference(trials), self.space.r).apply(trials)


class Potato(BatchOperator):
    """1 where a matrix's log-distance from the clean mean has a standard score under ``thresh``, else 0; ``score=True`` gives the score."""

    def __init__(self, a: str, output: str, center: np.ndarray, mu: float, sigma: float, thresh: float, r: float, score: bool = False):
        self.inputs, self.output = (a,), output
        self.center, self.mu, self.sigma, self.thresh, self.r, self.score = center, mu, sigma, thresh, r, score

    def infer(self, a: Shape) -> Shape:
        _square(a)
        return ()

    def scores(self, c: np.ndarray) -> np.ndarray:
        d = np.maximum(spd.distance(self.center, spd.regularise(c, self.r)), 1e-300)
        return (np.log(d) - self.mu) / self.sigma if self.sigma > 0 else np.where(np.log(d) > self.mu, np.inf, 0.0)

    def batch(self, a: np.ndarray) -> np.ndarray:
        z = self.scores(a)
        return z if self.score else (z < self.thresh).astype(float)


class RiemannPotato(Estimator):
    """Outlier detector (Barachant, Andreev & Congedo 2013): mean and spread are refitted without outliers until none is found.

    Training trials of rank 2 that aren't square are turned into covariances first.
    """

    def __init__(self, a: str, output: str, thresh: float = 3.0, max_iter: int = 100, regularization: float = 0.01):
        self.inputs, self.output, self.thresh, self.max_iter, self.r = (a,), output, thresh, max_iter, regularization

    def infer(self, a: Shape) -> Shape:
        _square(a)
        return ()

    def fit(self, trials: Trials) -> Operator:
        a, r = self.inputs[0], self.r
        if trials.shape(a)[0] != trials.shape(a)[1]:
            trials = Covariance(a, a).apply(trials)
        regular = lambda c: spd.regularise(c, r)
        with cached(trials, a) as held:
            clean, center, before = held, None, None
            try:
                for _ in range(self.max_iter):
                    starts = starting_points(clean, regular, START_DOUBLES) if center is None else {0.0: center}
                    center = flowed(clean, starts, regular)[0.0]
                    far = lambda c, m=center: np.log(np.maximum(spd.distance(m, regular(c)), 1e-300))[:, None]
                    found = moments_by(clean, "_c", [], False, far)[()]
                    potato = Potato("_c", "_clean", center, float(found.mean[0]), float(np.sqrt(found.covariance[0])), self.thresh, r)
                    if found.count == before:
                        break
                    before = found.count
                    # what this round leaves is held for the next one, which scores nothing again
                    left = potato.apply(clean).df.filter("_clean = 1").drop("_clean").persist(StorageLevel.MEMORY_AND_DISK)
                    left.count()
                    if clean is not held:
                        clean.df.unpersist()
                    clean = clean.with_df(left)
            finally:
                if clean is not held:
                    clean.df.unpersist()
        potato.inputs = (a,)
        potato.output = self.output
        return potato


class AdaptiveRebias(Operator):
    """B^-1/2 X B^-1/2 for each trial in turn; then B moves along the geodesic toward X by ``update_rate`` (None: 1 / trials seen).

    Trials of one recording (``by``) are taken in ``order`` by one task, as each depends on the one before.
    """

    def __init__(self, a: str, output: str, bias: np.ndarray, seen: int, order: str, by: Sequence[str] = (), update_rate: float | None = 0.1):
        self.inputs, self.output, self.bias, self.seen = (a,), output, bias, seen
        self.order, self.by, self.rate = order, tuple(by), update_rate

    def infer(self, a: Shape) -> Shape:
        return _square(a)

    def step(self, bias: np.ndarray, seen: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(recentred trial, bias after it, trials seen)."""
        w = spd.invsqrtm(bias)
        return w @ x @ w, spd.geodesic(bias, x, 1 / (seen + 1) if self.rate is None else self.rate), seen + 1

    def apply(self, trials: Trials) -> Trials:
        ship_package(trials.df.sparkSession)
        a, shape, order, output = self.inputs[0], self.infer(trials.shape(self.inputs[0])), self.order, self.output
        step, start, begun = self.step, self.bias, self.seen

        by = self.by

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, bias, seen = object(), start, begun
            for batch in batches:
                keys = list(zip(*(batch.column(batch.schema.names.index(b)).to_pylist() for b in by))) if by else [()] * batch.num_rows
                out = []
                for key, x in zip(keys, batch.column(batch.schema.names.index(a)).to_pylist()):
                    if key != at:
                        at, bias, seen = key, start, begun
                    if x is None:
                        out.append(None)
                        continue
                    y, bias, seen = step(bias, seen, np.asarray(x, float).reshape(shape))
                    out.append(y.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, output])

        # a recording's trials stream through one task in order; it holds one Arrow batch of them
        df = trials.df.drop(output) if output != a else trials.df
        dealt = df.repartition(*by).sortWithinPartitions(*by, order) if by else df.coalesce(1).sortWithinPartitions(order)
        kind = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])
        if output == a:
            raise ValueError("re-centred trials need a column of their own")
        return Trials(dealt.mapInArrow(run, kind), {**trials.shapes, output: shape}, trials.id, trials.label)


class AdaptiveRebiasFit(Estimator):
    """Start of ``AdaptiveRebias``: the mean of the training matrices. ``recentred`` gives each block of training trials about its own mean."""

    def __init__(self, a: str, output: str, order: str, by: Sequence[str] = (), update_rate: float | None = 0.1):
        self.inputs, self.output, self.order, self.by, self.rate = (a,), output, order, tuple(by), update_rate

    def infer(self, a: Shape) -> Shape:
        return _square(a)

    def fit(self, trials: Trials) -> Operator:
        return AdaptiveRebias(self.inputs[0], self.output, karcher_mean(trials, self.inputs[0]), trials.df.count(), self.order, self.by, self.rate)

    def recentred(self, trials: Trials, block: str) -> Trials:
        """Training trials, each about the mean of its ``block`` (a column of few values, each of which has a mean on the driver)."""
        a = self.inputs[0]
        blocks = [r[0] for r in trials.df.select(block).distinct().orderBy(block).collect()]
        number = F.coalesce(F.array_position(F.lit([b for b in blocks if b is not None]), F.col(block)), F.lit(0)).cast("double")
        marked = Trials(trials.df.withColumn("_block", number), {**trials.shapes, "_block": ()}, trials.id, "_block")
        means = karcher_means(marked, a)
        out = ByBlock(a, "_block", self.output, {k: spd.invsqrtm(m) for k, m in means.items()}).apply(marked)
        return Trials(out.df.drop("_block"), {k: v for k, v in out.shapes.items() if k != "_block"}, trials.id, trials.label)


class ByBlock(BatchOperator):
    """W C W for the W of each trial's block."""

    def __init__(self, a: str, block: str, output: str, w: dict[float, np.ndarray]):
        self.inputs, self.output, self.w = (a, block), output, w

    def infer(self, a: Shape, block: Shape) -> Shape:
        return _square(a)

    def batch(self, a: np.ndarray, block: np.ndarray) -> np.ndarray:
        w = np.stack([self.w[float(k)] for k in block]) if len(block) else a
        return w @ a @ w


class Congruence(BatchOperator):
    """W C W for a fixed symmetric W."""

    def __init__(self, a: str, output: str, w: np.ndarray):
        self.inputs, self.output, self.w = (a,), output, w

    def infer(self, a: Shape) -> Shape:
        return _square(a)

    def batch(self, a: np.ndarray) -> np.ndarray:
        return self.w @ a @ self.w
