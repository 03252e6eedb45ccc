"""Classifiers over feature vectors, clustering of brain states, and cross-validation."""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.functions import tensors as t
from kymo.numerics import learn, spd
from kymo.operators import cascade, ordered
from kymo.operators.base import BatchOperator, ColumnOperator, Estimator, Moments, Operator, Shape, Trials, cached, moments_by, partial_sums, sample_of, size_of
from kymo.operators.riemann import START_DOUBLES as MEAN_DOUBLES
from kymo.operators.riemann import ToTangent, flowed, karcher_mean, starting_points
from kymo.session import shared_path

#: Numbers that a driver-side learner may hold: its training set, for an SVM also the products of its trials.
MOST_DOUBLES = 50_000_000
#: Numbers of the sample that clusters start from.
START_DOUBLES = 2_000_000


def training_set(trials: Trials, column: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) on the driver, for learners that need trials at once.

    Above ``most`` trials it is those with the least hashes of their ids, about ``most`` of them and of each label its share.
    """
    size = size_of(trials.shape(column))
    x, y = sample_of(trials, column, most * size)
    return x.reshape(len(x), size), y


def known_trials(trials: Trials, column: str) -> int:
    """Trials with features and a label."""
    return trials.df.filter(F.col(column).isNotNull() & F.col(trials.label).isNotNull()).count()


class Predict(BatchOperator):
    """Labels of a fitted learner."""

    def __init__(self, a: str, output: str, learner: object):
        self.inputs, self.output, self.learner = (a,), output, learner

    def infer(self, a: Shape) -> Shape:
        return ()

    def batch(self, a: np.ndarray) -> np.ndarray:
        return np.asarray(self.learner.predict(a.reshape(len(a), -1)), float)


class PredictProba(BatchOperator):
    """Class probabilities of a fitted learner, classes in ascending order."""

    def __init__(self, a: str, output: str, learner: object, classes: int):
        self.inputs, self.output, self.learner, self.classes = (a,), output, learner, classes

    def infer(self, a: Shape) -> Shape:
        return (self.classes,)

    def batch(self, a: np.ndarray) -> np.ndarray:
        return np.asarray(self.learner.predict_proba(a.reshape(len(a), -1)), float)


class LinearPredict(ColumnOperator):
    """argmax of x coef' + intercept as a Catalyst expression; the first class wins ties."""

    def __init__(self, a: str, output: str, lda: learn.Lda):
        self.inputs, self.output, self.lda = (a,), output, lda

    def infer(self, a: Shape) -> Shape:
        return ()

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        scores = t.bound(lambda x: F.array(*[t.dot(x, w) + float(b) for w, b in zip(self.lda.coef, self.lda.intercept)]), columns[0])
        best = t.bound(lambda s: F.array_position(s, F.array_max(s)), scores)
        return F.get(F.lit([float(c) for c in self.lda.classes]), (best - 1).cast("int"))


class BothOutputs(Operator):
    """Labels in ``output`` and probabilities in ``proba``."""

    def __init__(self, predict: Operator, proba: Operator | None):
        self.inputs, self.output, self.predict, self.proba = predict.inputs, predict.output, predict, proba

    def infer(self, a: Shape) -> Shape:
        return ()

    def apply(self, trials: Trials) -> Trials:
        out = self.predict.apply(trials)
        return self.proba.apply(out) if self.proba else out


class Classifier(Estimator):
    """Any object with fit and predict (and predict_proba for ``proba``); tensors are flattened.

    LDA and logistic regression are fitted from sums on the executors, over all trials; an SVM on all trials by a cascade
    (``kymo.operators.cascade``) where their products don't fit the driver. Learners of a user's own are fitted on the
    whole training set or, above ``MOST_DOUBLES`` numbers, on a sample (``training_set``).
    """

    def __init__(self, a: str, output: str, learner: object, proba: str | None = None, num_classes: int | None = None):
        if not (hasattr(learner, "fit") and hasattr(learner, "predict")):
            raise TypeError("a classifier has fit and predict")
        if proba and not hasattr(learner, "predict_proba"):
            raise TypeError("probabilities need predict_proba")
        self.inputs, self.output, self.learner, self.proba, self.num_classes = (a,), output, learner, proba, num_classes

    def infer(self, a: Shape) -> Shape:
        return ()

    def fit(self, trials: Trials) -> Operator:
        a, learner = self.inputs[0], self.learner
        if isinstance(learner, learn.Lda):
            classes = self._fit_sums(trials, learner)
        elif isinstance(learner, learn.Logistic):
            classes = self._fit_logistic(trials, learner)
        else:
            most = max(1, MOST_DOUBLES // size_of(trials.shape(a)))
            if isinstance(learner, learn.Svm) and known_trials(trials, a) > min(most, math.isqrt(MOST_DOUBLES)):
                classes = cascade.fit(trials, a, learner, MOST_DOUBLES)
            else:
                x, y = training_set(trials, a, most)
                learner.fit(x, y)
                classes = np.unique(y)
        return self._operator(learner, classes, trials.shape(a))

    def _operator(self, learner: object, classes: np.ndarray, shape: Shape) -> Operator:
        a = self.inputs[0]
        if self.num_classes is not None and len(classes) != self.num_classes:
            raise ValueError(f"{len(classes)} classes, not {self.num_classes}")
        predict = LinearPredict(a, self.output, learner) if isinstance(learner, learn.Lda) and len(shape) == 1 else Predict(a, self.output, learner)
        return BothOutputs(predict, PredictProba(a, self.proba, learner, len(classes)) if self.proba else None)

    def moments(self, trials: Trials, *groups: Column) -> dict[tuple, Moments] | None:
        """Of features by label, for learners that these determine (LDA without automatic shrinkage)."""
        if not isinstance(self.learner, learn.Lda) or self.learner.shrinkage == "auto":
            return None
        return moments_by(trials, self.inputs[0], [F.col(trials.label), *groups], True)

    def from_moments(self, found: dict[tuple, Moments], shape: Shape) -> Operator:
        lda = copy.copy(self.learner)
        return self._operator(lda, self._pooled(lda, found), shape)

    def _pooled(self, lda: learn.Lda, found: dict[tuple, Moments]) -> np.ndarray:
        own, classes = list(found.values()), np.array([k[0] for k in found])
        counts = np.array([m.count for m in own], float)
        priors = counts / counts.sum() if lda.priors is None else np.asarray(lda.priors, float)
        pooled = sum(p * (m.covariance if lda.shrinkage is None else learn.shrunk(m.covariance, float(lda.shrinkage))) for m, p in zip(own, priors))
        lda.from_statistics(classes, np.stack([m.mean for m in own]), pooled, priors)
        return classes

    def _fit_sums(self, trials: Trials, lda: learn.Lda) -> np.ndarray:
        if lda.shrinkage == "auto":
            if lda.solver == "svd":
                raise ValueError("shrinkage goes with the solvers lsqr and eigen")
            return self._fit_auto(trials, lda)
        return self._pooled(lda, self.moments(trials))

    def _fit_logistic(self, trials: Trials, learner: learn.Logistic) -> np.ndarray:
        """Newton steps; each is one pass that brings loss, gradient and Hessian to the driver."""
        a = self.inputs[0]
        with cached(trials, a, F.col(trials.label)) as held:
            known = held.df.groupBy("_y").agg(F.count("*").alias("n")).filter("_y is not null").orderBy("_y").collect()
            classes, counts = np.array([r["_y"] for r in known]), np.array([r["n"] for r in known])
            labelled = Trials(held.df.filter("_y is not null"), held.shapes, held.id, held.label)

            def sums(w: np.ndarray, weights: np.ndarray) -> np.ndarray:
                part = lambda x, y: learn.logistic_sums(x.reshape(len(x), -1), np.searchsorted(classes, y), w, weights)
                return partial_sums(labelled, "_c", part, False, with_labels=True, summed=True)[0]["sum"]

            learner.fit_sums(classes, counts, size_of(trials.shape(a)), sums)
        return classes

    def _fit_auto(self, trials: Trials, lda: learn.Lda) -> np.ndarray:
        """Ledoit-Wolf shrinkage from two passes: means, then products of what is centred and of its squares."""
        a = self.inputs[0]
        found = partial_sums(trials, a, lambda x: x.reshape(len(x), -1), True)
        classes, counts = np.array([g["label"] for g in found]), np.array([g["count"] for g in found], float)
        means = np.stack([g["sum"] / g["count"] for g in found])
        n = means.shape[1]

        def products(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
            c = x.reshape(len(x), -1) - means[np.searchsorted(classes, labels)]
            return np.concatenate([(z.T @ z).ravel() for z in (c, c**2)])

        priors = counts / counts.sum() if lda.priors is None else np.asarray(lda.priors, float)
        pooled = np.zeros((n, n))
        for g, p in zip(partial_sums(trials, a, products, True, True, summed=True), priors):
            own, squares = (g["sum"] / g["count"]).reshape(2, n, n)
            scale = np.sqrt(np.diag(own))
            scale[scale == 0] = 1
            pair = np.outer(scale, scale)
            s = own / pair  # of standardised data, scaled back below
            mu = np.trace(s) / n
            spread = ((s - mu * np.eye(n)) ** 2).sum() / n
            noise = ((squares / pair**2).sum() - (s**2).sum()) / (g["count"] * n)
            pooled += p * pair * learn.shrunk(s, 0.0 if spread == 0 else min(max(noise, 0.0), spread) / spread)
        lda.from_statistics(classes, means, pooled, priors)
        return classes


def lda(solver: str = "svd", shrinkage: str | float | None = None, priors: Sequence[float] | None = None, tol: float | None = None) -> learn.Lda:
    return learn.Lda(solver, shrinkage, list(priors) if priors is not None else None, tol)


def svm(C: float = 1.0, kernel: str = "rbf", degree: int = 3, gamma: str | float = "scale", coef0: float = 0.0, tol: float = 1e-3,
        class_weight: str | dict | None = None, max_iter: int = 100_000, probability: bool = False) -> learn.Svm:
    return learn.Svm(C, kernel, degree, gamma, coef0, tol, max_iter, class_weight, probability)


def logistic_regression(C: float = 1.0, max_iter: int = 100, penalty: str | None = "l2", fit_intercept: bool = True,
                        class_weight: str | dict | None = None, tol: float = 1e-8, l1_ratio: float | None = None) -> learn.Logistic:
    return learn.Logistic(C, max_iter, tol, penalty, fit_intercept, class_weight, l1_ratio)


# ---- clustering ----


@dataclass
class PotatoClustering:
    """k-means, then one potato for each cluster: the cluster with the least score, or ``k`` (an outlier) above ``threshold``."""

    centers: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    threshold: float = 2.0

    def scores(self, c: np.ndarray) -> np.ndarray:
        d = np.stack([spd.distance(m, c) for m in self.centers], axis=1)
        return (np.log(np.maximum(d, 1e-300)) - self.mu) / np.where(self.sigma > 0, self.sigma, 1.0)

    def predict(self, c: np.ndarray) -> np.ndarray:
        z = self.scores(c)
        return np.where(z.min(axis=1) > self.threshold, len(self.centers), z.argmin(axis=1)).astype(float)

    def update(self, c: np.ndarray, rate: float) -> None:
        """Each matrix moves its cluster's centre along the geodesic."""
        for x, k in zip(c, self.predict(c).astype(int)):
            if k < len(self.centers):
                self.centers[k] = spd.geodesic(self.centers[k], x, rate)


class MultiPotato(BatchOperator):
    def __init__(self, a: str, output: str, model: PotatoClustering):
        self.inputs, self.output, self.model = (a,), output, model

    def infer(self, a: Shape) -> Shape:
        return ()

    def batch(self, a: np.ndarray) -> np.ndarray:
        return self.model.predict(a)

    def update(self, a: np.ndarray, rate: float) -> None:
        self.model.update(a, rate)


class States(BatchOperator):
    """Nearest centre of (scaled) features; ``proba`` gives softmax of negative squared distances instead."""

    def __init__(self, a: str, output: str, offset: np.ndarray, scale: np.ndarray, centers: np.ndarray, proba: bool = False):
        self.inputs, self.output, self.offset, self.scale, self.centers, self.proba = (a,), output, offset, scale, centers, proba

    def infer(self, a: Shape) -> Shape:
        return (len(self.centers),) if self.proba else ()

    def scaled(self, a: np.ndarray) -> np.ndarray:
        return (a.reshape(len(a), -1) - self.offset) / self.scale

    def batch(self, a: np.ndarray) -> np.ndarray:
        d = ((self.scaled(a)[:, None] - self.centers) ** 2).sum(-1)
        if not self.proba:
            return d.argmin(1).astype(float)
        e = np.exp(-(d - d.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def update(self, a: np.ndarray, rate: float) -> None:
        """Centres follow the features that they win, by an exponential average."""
        x = self.scaled(a)
        for row, k in zip(x, ((x[:, None] - self.centers) ** 2).sum(-1).argmin(1)):
            self.centers[k] = (1 - rate) * self.centers[k] + rate * row


def lloyd(held: Trials, flows: dict, scale: Callable[[np.ndarray], np.ndarray], mine: Callable[[object, np.ndarray], np.ndarray]) -> None:
    """Run ``learn.Lloyd`` flows over all ``cached`` trials to their ends; all share each pass.

    ``mine(key, labels)`` tells which trials a flow sees; labels are hashes of trial ids.
    """
    while open_flows := {k: f for k, f in flows.items() if not f.done}:

        def sums(x: np.ndarray, y: np.ndarray, open_flows: dict = open_flows) -> np.ndarray:
            x = scale(x)
            return np.concatenate([f.sums(x[mine(k, y)]) for k, f in open_flows.items()])

        found, at = partial_sums(held, "_c", sums, False, with_labels=True, summed=True)[0]["sum"], 0
        for f in open_flows.values():
            n = len(f.centres) * (1 + f.centres.shape[1])
            f.advance(found[at : at + n])
            at += n


class PatternState(Estimator):
    """Clusters of tangent vectors: tangent space, scaling, k-means; gives each trial's state and probabilities.

    k is ``n_clusters`` or, with ``pred_strength``, the largest of ``k_range`` whose prediction strength (mean plus standard
    error over half splits, Tibshirani & Walther 2005) reaches ``k_sel_thresh``; 1 cluster if none does. All of it runs over all
    trials: rounds of k-means are passes that bring sums to the driver, shared by all k and splits. Only the
    first centres come from a sample, of about ``START_DOUBLES`` numbers; halves are bits of a hash of the trial's id.
    """

    SPLITS = 10

    def __init__(self, a: str, output: str, proba: str | None = None, k_selection: str = "pred_strength", n_clusters: int = 2,
                 k_sel_thresh: float = 0.5, k_range: tuple[int, int] = (2, 10), tangent_space: bool = True, scale_data: bool = True, seed: int = 0):
        if k_selection not in ("pred_strength", "fixed"):
            raise ValueError("k_selection is pred_strength or fixed")
        self.inputs, self.output, self.proba = (a,), output, proba
        self.k_selection, self.n_clusters, self.limit, self.k_range = k_selection, n_clusters, k_sel_thresh, k_range
        self.tangent_space, self.scale_data, self.seed = tangent_space, scale_data, seed

    def infer(self, a: Shape) -> Shape:
        return ()

    def fit(self, trials: Trials) -> Operator:
        a = self.inputs[0]
        first = ToTangent(a, "_features", karcher_mean(trials, a)) if self.tangent_space else None
        features = first.apply(trials) if first else trials.with_column("_features", F.col(a), trials.shape(a))
        # 32 bits of a hash of the id, as a number that doubles hold: bit s is the half of split s
        halves = F.shiftrightunsigned(F.xxhash64(F.col(trials.id).cast("string"), F.lit(self.seed)), 32).cast("double")
        with cached(features, "_features", halves) as held:
            return self._fit(a, first, held)

    def _fit(self, a: str, first: Operator | None, held: Trials) -> Operator:
        size = size_of(held.shape("_c"))
        whole = moments_by(held, "_c", [], False)
        if not whole:
            raise ValueError("clusters need trials")
        whole = whole[()]
        n = whole.count
        offset, scale = (whole.mean, np.sqrt(whole.covariance)) if self.scale_data else (np.zeros(size), np.ones(size))
        scale = np.where(scale > 1e-12 * np.maximum(1.0, np.abs(offset)), scale, 1.0)
        scaled = lambda x: (x.reshape(len(x), -1) - offset) / scale
        start, bits = sample_of(held, "_c", START_DOUBLES, n)
        start = scaled(start)
        k = self.n_clusters if self.k_selection == "fixed" else self._strongest(held, scaled, start, bits, n)
        centres = {"all": learn.Lloyd(learn.kmeans(start, k, self.seed)[0])}
        lloyd(held, centres, scaled, lambda _, y: np.ones(len(y), bool))
        states = States("_features", self.output, offset, scale, centres["all"].centres)
        proba = States("_features", self.proba, offset, scale, centres["all"].centres, True) if self.proba else None
        return _StatesOf(a, first, states, proba)

    def _strongest(self, held: Trials, scaled: Callable[[np.ndarray], np.ndarray], start: np.ndarray, bits: np.ndarray, n: int) -> int:
        half = lambda s, y: (y.astype(np.int64) >> s & 1).astype(bool)
        mine = lambda key, y: half(key[1], y) == key[2]
        flows = {}
        for k in range(self.k_range[0], min(self.k_range[1], n // 4) + 1):
            for split in range(self.SPLITS):
                parts = {side: start[half(split, bits) == side] for side in (False, True)}
                if min(map(len, parts.values())) >= k:
                    flows |= {(k, split, side): learn.Lloyd(learn.kmeans(x, k, self.seed)[0]) for side, x in parts.items()}
        if not flows:
            return 1
        lloyd(held, flows, scaled, mine)
        tests = [key for key in flows if key[2]]

        def together(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x, out = scaled(x), []
            for key in tests:
                some, counts = x[mine(key, y)], np.zeros((key[0], key[0]))
                np.add.at(counts, (learn.nearest(some, flows[key].centres), learn.nearest(some, flows[(*key[:2], False)].centres)), 1)
                out.append(counts.ravel())
            return np.concatenate(out)

        found, at, strengths = partial_sums(held, "_c", together, False, with_labels=True, summed=True)[0]["sum"], 0, {}
        for key in tests:
            strengths.setdefault(key[0], []).append(learn.strength(found[at : at + key[0] ** 2].reshape(key[0], key[0])))
            at += key[0] ** 2
        return max((k for k, s in strengths.items() if np.mean(s) + np.std(s) / math.sqrt(len(s)) >= self.limit), default=1)


class _StatesOf(Operator):
    def __init__(self, a: str, first: Operator | None, states: States, proba: States | None):
        self.inputs, self.output, self.first, self.states, self.proba = (a,), states.output, first, states, proba

    def infer(self, a: Shape) -> Shape:
        return ()

    def update(self, a: np.ndarray, rate: float) -> None:
        """Centres follow trials' features; both outputs share them."""
        self.states.update(self.first.batch(a) if self.first else a, rate)

    def apply(self, trials: Trials) -> Trials:
        a = self.inputs[0]
        out = self.first.apply(trials) if self.first else trials.with_column("_features", F.col(a), trials.shape(a))
        out = self.states.apply(out)
        out = self.proba.apply(out) if self.proba else out
        return Trials(out.df.drop("_features"), {k: v for k, v in out.shapes.items() if k != "_features"}, out.id, out.label)


class MultiPotatoFit(Estimator):
    """``PotatoClustering`` of matrices: k-means on their tangent vectors names the clusters, each gets a mean and spread."""

    def __init__(self, a: str, output: str, n_clusters: int = 2, threshold: float = 2.0, seed: int = 0):
        self.inputs, self.output, self.k, self.threshold, self.seed = (a,), output, n_clusters, threshold, seed

    def infer(self, a: Shape) -> Shape:
        return ()

    def fit(self, trials: Trials) -> Operator:
        a = self.inputs[0]
        marked = PatternState(a, "_cluster", k_selection="fixed", n_clusters=self.k, seed=self.seed).fit(trials).apply(trials)
        with cached(marked, a, F.col("_cluster")) as held:
            return self._fit(held.with_df(held.df.filter("_y is not null")))

    def _fit(self, held: Trials) -> Operator:
        same = lambda c: c
        means = flowed(held, starting_points(held, same, MEAN_DOUBLES), same)
        centers = np.stack([means[float(k)] for k in range(self.k)])

        def spread(c: np.ndarray, y: np.ndarray) -> np.ndarray:
            d = np.log(np.maximum(spd.distance(centers[int(y[0])], c), 1e-300))  # trials come cluster by cluster
            return np.array([d.sum(), (d**2).sum()])

        found = {g["label"]: g for g in partial_sums(held, "_c", spread, True, with_labels=True, summed=True)}
        mu = np.array([found[float(k)]["sum"][0] / found[float(k)]["count"] for k in range(self.k)])
        squares = np.array([found[float(k)]["sum"][1] / found[float(k)]["count"] for k in range(self.k)])
        return MultiPotato(self.inputs[0], self.output, PotatoClustering(centers, mu, np.sqrt(np.maximum(0.0, squares - mu**2)), self.threshold))


# ---- model selection ----


def stratified_folds(df: DataFrame, label: str, order: str, folds: int = 5, shuffle_seed: int | None = None) -> DataFrame:
    """``df`` with fold (0 to ``folds`` - 1): within each label by ``order``, or by a seeded hash of it; sizes differ by one at most."""
    if folds < 2:
        raise ValueError("at least two folds")
    by = [F.col(order)] if shuffle_seed is None else [F.xxhash64(F.col(order), F.lit(shuffle_seed)), F.col(order)]
    place = ordered.earlier(df, [label], by, {"_place_in_class": F.lit(True)})  # over all tasks, however large a class is
    return place.withColumn("fold", (F.col("_place_in_class") % folds).cast("int")).drop("_place_in_class")


METRICS = ("accuracy", "f1", "precision", "recall", "cross_entropy")


def metric(df: DataFrame, label: str, predicted: str, statistic: str = "accuracy", proba: str | None = None, average: str = "binary", positive: float = 1.0) -> float:
    """A statistic of predictions, from one aggregate; ``macro`` averages one-against-rest over labels."""
    if statistic not in METRICS:
        raise ValueError(f"statistic is one of {METRICS}")
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    if statistic == "cross_entropy":
        classes = F.lit([float(r[0]) for r in df.select(y).distinct().orderBy(y).collect()])
        q = F.get(F.col(proba), (F.array_position(classes, y) - 1).cast("int"))
        return float(df.agg(F.avg(-F.ln(F.greatest(q, F.lit(1e-15))))).first()[0])
    counts = {(r["y"], r["p"]): r["n"] for r in df.groupBy(y.alias("y"), p.alias("p")).agg(F.count("*").alias("n")).collect()}  # by pairs of labels
    return from_counts(counts, statistic, average, positive)


def from_counts(counts: dict[tuple[float, float], int], statistic: str, average: str = "binary", positive: float = 1.0) -> float:
    """A statistic from how often each pair of label and prediction comes."""
    if statistic == "accuracy":
        total = sum(n for (y, p), n in counts.items() if y is not None and p is not None)
        return sum(n for (y, p), n in counts.items() if y is not None and y == p) / total if total else math.nan
    out = []
    for c in [positive] if average == "binary" else sorted({y for y, _ in counts if y is not None}):
        hit = counts.get((c, c), 0)
        said, true = (sum(n for pair, n in counts.items() if pair[i] == c) for i in (1, 0))
        precision, recall = (hit / said if said else 0.0), (hit / true if true else 0.0)
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out.append({"precision": precision, "recall": recall, "f1": f1}[statistic])
    return float(np.mean(out))


@dataclass
class CrossValidation:
    """Mean of a statistic over stratified folds; ``build`` gives the plan (see kymo.plans.pipeline) to fit in each.

    The plans of all folds are fitted in step. An estimator that moments determine (``moments`` and ``from_moments``: normalisation to
    deviations, selection, CSP, xDAWN, LDA without automatic shrinkage) reads the trials once for all folds: moments of each
    fold are merged for those that train on it. Behind an estimator that differs between folds, a trial goes along once for each fold that trains on it, in one pass as well.
    Other estimators are fitted fold by fold, some at a time. All folds are tested in one job. Trials are written once, by fold.
    """

    build: Callable[[], object]
    predicted: str
    folds: int = 5
    statistic: str = "accuracy"
    shuffle_seed: int | None = None
    proba: str | None = None
    average: str = "binary"
    scores: list[float] = field(default_factory=list)

    def run(self, trials: Trials) -> float:
        spark, path = trials.df.sparkSession, shared_path(trials.df.sparkSession, "folds")
        dealt = stratified_folds(trials.df, trials.label, trials.id, self.folds, self.shuffle_seed)
        dealt.write.partitionBy("fold").parquet(path)
        marked = trials.with_df(spark.read.schema(dealt.schema).parquet(path))
        fitted = self._fitted(marked)
        parts = []
        for k, operators in enumerate(fitted):
            tested = marked.with_df(marked.df.filter(F.col("fold") == k))
            for o in operators:
                tested = o.apply(tested)
            parts.append(tested.df.select("fold", F.col(trials.label).cast("double").alias("y"), F.col(self.predicted).cast("double").alias("p"), *([F.col(self.proba).alias("q")] if self.proba else [])))
        self.scores = self._scores(functools.reduce(DataFrame.unionByName, parts))
        return float(np.mean(self.scores))

    def _fitted(self, marked: Trials) -> list[list[Operator]]:
        """The operators of each fold."""
        stages = [self.build().ordered(marked.shapes) for _ in range(self.folds)]
        last = max((i for i, s in enumerate(stages[0]) if isinstance(s, Estimator)), default=-1)
        done: list[list[Operator]] = [[] for _ in range(self.folds)]
        shared = marked  # trials behind the stages that all folds have in common; None once they differ
        for i, own in enumerate(zip(*stages)):
            if not isinstance(own[0], Estimator):
                shared = own[0].apply(shared) if shared is not None and i < last else shared
                found = list(own)
            else:
                found = self._fit_stage(own, marked, shared, done)
                shared = None
            for k, o in enumerate(found):
                done[k].append(o)
        return done

    def _fit_stage(self, own: Sequence[Estimator], marked: Trials, shared: Trials | None, done: list[list[Operator]]) -> list[Operator]:
        first, folds = own[0], range(self.folds)
        if shared is not None:
            moments = first.moments(shared, F.col("fold")) if hasattr(first, "moments") else None
            if moments is not None:
                shape = shared.shape(first.inputs[0])
                return [e.from_moments(_merged(moments, lambda fold, k=k: fold != k), shape) for k, e in enumerate(own)]
        elif hasattr(first, "moments"):
            spread, shape = self._spread(first.inputs[0], marked, done)
            moments = first.moments(spread, F.col("_fold_of"))
            if moments is not None:
                return [e.from_moments(_merged(moments, lambda fold, k=k: fold == k), shape) for k, e in enumerate(own)]

        def fit(k: int) -> Operator:
            train = (shared or marked).with_df((shared or marked).df.filter(F.col("fold") != k))
            for o in done[k] if shared is None else []:
                train = o.apply(train)
            return own[k].fit(train)

        with ThreadPoolExecutor(min(self.folds, AT_ONCE)) as pool:
            return list(pool.map(fit, folds))

    def _spread(self, column: str, marked: Trials, done: list[list[Operator]]) -> tuple[Trials, Shape]:
        """Each trial once for each fold that trains on it, with that fold's ``column``."""
        df, shape = marked.df, None
        for k, operators in enumerate(done):
            here = Trials(df, marked.shapes, marked.id, marked.label)
            for o in operators:
                here = o.apply(here)
            shape = here.shape(column)
            df = here.df.select(*df.columns, F.when(F.col("fold") != k, F.col(column)).alias(f"_of_fold_{k}"))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_of_fold_{k}").alias("v")) for k in range(self.folds)])).alias("_e")
        rows = df.select(marked.id, marked.label, each).select(marked.id, marked.label, F.col("_e.k").alias("_fold_of"), F.col("_e.v").alias(column))
        return Trials(rows.filter(F.col(column).isNotNull()), {column: shape}, marked.id, marked.label), shape

    def _scores(self, tested: DataFrame) -> list[float]:
        if self.statistic not in METRICS:
            raise ValueError(f"statistic is one of {METRICS}")
        if self.statistic != "cross_entropy":
            counts: list[dict] = [{} for _ in range(self.folds)]
            for r in tested.groupBy("fold", "y", "p").count().collect():
                counts[r["fold"]][r["y"], r["p"]] = r["count"]
            return [from_counts(c, self.statistic, self.average) for c in counts]
        classes = {r["fold"]: sorted(y for y in r["ys"]) for r in tested.groupBy("fold").agg(F.collect_set("y").alias("ys")).collect()}
        place = functools.reduce(lambda c, k: c.when(F.col("fold") == k, F.array_position(F.lit([float(y) for y in classes[k]]), F.col("y"))), classes, F.when(F.lit(False), F.lit(0).cast("long")))
        q = F.get(F.col("q"), (place - 1).cast("int"))
        found = {r["fold"]: r["v"] for r in tested.groupBy("fold").agg(F.avg(-F.ln(F.greatest(q, F.lit(1e-15)))).alias("v")).collect()}
        return [float(found[k]) for k in range(self.folds)]


#: Folds whose estimators are fitted at the same time where each needs passes of its own.
AT_ONCE = 4


def _merged(found: dict[tuple, Moments], wanted: Callable[[float], bool]) -> dict[tuple, Moments]:
    """Moments without the group in their keys, those of the wanted groups together."""
    out: dict[tuple, Moments] = {}
    for key, m in found.items():
        then = key[-1:] if key[-1] == "then" else ()
        rest = key[: len(key) - len(then)]
        if wanted(rest[-1]):
            short = (*rest[:-1], *then)
            out[short] = out[short].merged(m) if short in out else m
    return dict(sorted(out.items(), key=str))
