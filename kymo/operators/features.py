"""Fitted normalisation, selection and spatial filters.

Statistics are sums by element, label and batch, aggregated on the executors; what comes to the driver has the size of
one trial (or its square) for each class, whatever the number of trials.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kymo.functions import tensors as t
from kymo.numerics import learn, spd
from kymo.operators.base import BatchOperator, ColumnOperator, Estimator, Moments, Operator, Shape, Trials, merge_all, moments_by, size_of


class Affine(ColumnOperator):
    """(x - offset) / scale, element by element, or with one offset and scale for all."""

    def __init__(self, a: str, output: str, offset: np.ndarray, scale: np.ndarray):
        self.inputs, self.output, self.offset, self.scale = (a,), output, offset, scale

    def infer(self, a: Shape) -> Shape:
        return a

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        if np.size(self.offset) == 1:
            offset, scale = float(np.ravel(self.offset)[0]), float(np.ravel(self.scale)[0])
            return t.unary(columns[0], shapes[0], lambda x: t.divide(x - offset, F.lit(scale)))
        pairs = F.arrays_zip(F.lit([float(v) for v in np.ravel(self.offset)]).alias("o"), F.lit([float(v) for v in np.ravel(self.scale)]).alias("s"))
        return F.zip_with(columns[0], pairs, lambda x, p: t.divide(x - p["o"], p["s"]))


class ZScore(Estimator):
    """(x - mean) / deviation over all values of the training trials, n - 1 in the denominator."""

    def __init__(self, a: str, output: str):
        self.inputs, self.output = (a,), output

    def infer(self, a: Shape) -> Shape:
        return a

    def fit(self, trials: Trials) -> Operator:
        a = self.inputs[0]
        values = trials.df.select(F.col(a).alias("v")) if trials.shape(a) == () else trials.df.select(F.explode(a).alias("v"))
        m, s = values.agg(F.avg("v"), F.stddev_samp("v")).first()
        return Affine(a, self.output, np.array([m]), np.array([np.nan if s is None else s]))


METHODS = ("min-max", "mean-norm", "zscore-norm")


class FeatureNormalization(Estimator):
    """Each element over training trials: ``min-max`` (x - min) / (max - min), ``mean-norm`` (x - mean) / (max - min),
    ``zscore-norm`` (x - mean) / deviation with n in the denominator."""

    def __init__(self, a: str, output: str, method: str = "zscore-norm"):
        if method not in METHODS:
            raise ValueError(f"method is one of {METHODS}")
        self.inputs, self.output, self.method = (a,), output, method

    def infer(self, a: Shape) -> Shape:
        return a

    def moments(self, trials: Trials, *groups: Column) -> dict[tuple, Moments] | None:
        """Means and squares; extremes aren't moments, so ``min-max`` and ``mean-norm`` have none."""
        return moments_by(trials, self.inputs[0], groups, False) if self.method == "zscore-norm" else None

    def from_moments(self, found: dict[tuple, Moments], shape: Shape) -> Operator:
        whole = merge_all(found.values())
        return Affine(self.inputs[0], self.output, whole.mean, np.sqrt(whole.covariance))

    def fit(self, trials: Trials) -> Operator:
        a = self.inputs[0]
        values = trials.df.select(F.posexplode(a).alias("i", "v")).groupBy("i")
        rows = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
        low, high, mean, deviation = (np.array([r[c] for r in rows]) for c in ("lo", "hi", "m", "s"))
        offset = low if self.method == "min-max" else mean
        return Affine(a, self.output, offset, deviation if self.method == "zscore-norm" else high - low)


class Selected(ColumnOperator):
    """The elements at static positions, flattened."""

    def __init__(self, a: str, output: str, index: np.ndarray):
        self.inputs, self.output, self.index = (a,), output, index

    def infer(self, a: Shape) -> Shape:
        return (len(self.index),)

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        return t.gather(columns[0], self.index)


class FeatureSelection(Estimator):
    """The ``k`` elements with the highest ANOVA F between labels, in their own order; ties go to the first."""

    def __init__(self, a: str, output: str, k: int = 10):
        self.inputs, self.output, self.k = (a,), output, k

    def infer(self, a: Shape) -> Shape:
        if not 1 <= self.k <= size_of(a):
            raise ValueError(f"k lies between 1 and {size_of(a)}")
        return (self.k,)

    def moments(self, trials: Trials, *groups: Column) -> dict[tuple, Moments]:
        return moments_by(trials, self.inputs[0], [F.col(trials.label), *groups], False)

    def from_moments(self, found: dict[tuple, Moments], shape: Shape) -> Operator:
        own = list(found.values())
        f = learn.anova_f_centred(np.array([m.count for m in own], float), np.stack([m.mean for m in own]), np.stack([m.centred for m in own]))
        order = np.argsort(-np.where(np.isnan(f), -np.inf, f), kind="stable")
        return Selected(self.inputs[0], self.output, np.sort(order[: self.k]))

    def fit(self, trials: Trials) -> Operator:
        return self.from_moments(self.moments(trials), trials.shape(self.inputs[0]))


def _samples(x: np.ndarray) -> np.ndarray:
    """Samples of trials (channels, samples) as rows."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


class SpatialFilter(BatchOperator):
    """filters @ trial."""

    def __init__(self, a: str, output: str, filters: np.ndarray):
        self.inputs, self.output, self.filters = (a,), output, filters

    def infer(self, a: Shape) -> Shape:
        return (len(self.filters), a[1])

    def batch(self, a: np.ndarray) -> np.ndarray:
        return self.filters @ a


class Csp(Estimator):
    """Common spatial patterns of trials (channels, samples); ``concat`` covariances come from all of a class's samples
    together, ``epoch`` covariances are means over trials. ``reg`` moves them toward the identity."""

    def __init__(self, a: str, output: str, n_components: int = 4, cov_est: str = "concat", reg: float | None = None):
        if cov_est not in ("concat", "epoch"):
            raise ValueError("cov_est is concat or epoch")
        self.inputs, self.output, self.n_components, self.cov_est, self.reg = (a,), output, n_components, cov_est, reg

    def infer(self, a: Shape) -> Shape:
        if len(a) != 2 or not 1 <= self.n_components <= a[0]:
            raise ValueError("trials are (channels, samples), components no more than channels")
        return (self.n_components, a[1])

    def moments(self, trials: Trials, *groups: Column) -> dict[tuple, Moments]:
        """Of samples, or with ``epoch`` of trials' covariances."""
        rows = (lambda x: spd.covariance(x).reshape(len(x), -1)) if self.cov_est == "epoch" else _samples
        return moments_by(trials, self.inputs[0], [F.col(trials.label), *groups], self.cov_est == "concat", rows)

    def from_moments(self, found: dict[tuple, Moments], shape: Shape) -> Operator:
        covariances = []
        for m in found.values():
            c = m.mean.reshape(shape[0], shape[0]) if self.cov_est == "epoch" else m.centred / (m.count - 1)
            covariances.append(c if self.reg is None else spd.regularise(c, self.reg))
        if len(covariances) < 2:
            raise ValueError("common spatial patterns need two classes")
        return SpatialFilter(self.inputs[0], self.output, learn.csp_filters(covariances, self.n_components))

    def fit(self, trials: Trials) -> Operator:
        return self.from_moments(self.moments(trials), trials.shape(self.inputs[0]))


class PrototypeCovariance(BatchOperator):
    """Covariance of class prototypes stacked on the filtered trial."""

    def __init__(self, a: str, output: str, prototypes: np.ndarray, filters: np.ndarray):
        self.inputs, self.output, self.prototypes, self.filters = (a,), output, prototypes, filters

    def infer(self, a: Shape) -> Shape:
        side = len(self.prototypes) + len(self.filters)
        return (side, side)

    def batch(self, a: np.ndarray) -> np.ndarray:
        fixed = np.broadcast_to(self.prototypes, (len(a), *self.prototypes.shape))
        return spd.covariance(np.concatenate([fixed, self.filters @ a], axis=1))


class XDawnCovariance(Estimator):
    """xDAWN filters and class prototypes; gives covariances of side 2 * classes * ``num_filters``."""

    def __init__(self, a: str, output: str, num_filters: int = 4, n_classes: int = 2, classes: list | None = None):
        self.inputs, self.output, self.num_filters, self.n_classes, self.classes = (a,), output, num_filters, n_classes, classes

    def infer(self, a: Shape) -> Shape:
        if len(a) != 2 or self.num_filters > a[0]:
            raise ValueError("trials are (channels, samples), filters no more than channels")
        side = 2 * self.num_filters * (len(self.classes) if self.classes else self.n_classes)
        return (side, side)

    def moments(self, trials: Trials, *groups: Column) -> dict[tuple, Moments]:
        """Of samples, and beside them of whole trials."""
        return moments_by(trials, self.inputs[0], [F.col(trials.label), *groups], True, _samples, lambda x: x.reshape(len(x), -1))

    def from_moments(self, found: dict[tuple, Moments], shape: Shape) -> Operator:
        data = merge_all(m for k, m in found.items() if k[-1] != "then").covariance
        evoked = [m.mean.reshape(shape) for k, m in found.items() if k[-1] == "then" and (self.classes is None or k[0] in self.classes)]
        filters = [learn.xdawn_filters(e, data, self.num_filters) for e in evoked]
        return PrototypeCovariance(self.inputs[0], self.output, np.vstack([w @ e for w, e in zip(filters, evoked)]), np.vstack(filters))

    def fit(self, trials: Trials) -> Operator:
        return self.from_moments(self.moments(trials), trials.shape(self.inputs[0]))
