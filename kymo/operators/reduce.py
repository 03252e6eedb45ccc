"""Reductions of a trial's tensor along one axis (None: all elements), without a shuffle.

``keepdims`` leaves an axis of length one. NaN makes an extreme NaN; moments of constant lanes are NaN.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kymo.functions import tensors as t
from kymo.numerics import spd
from kymo.operators.base import BatchOperator, ColumnOperator, Shape, norm_axis


class Reduction(ColumnOperator):
    def __init__(self, a: str, output: str, axis: int | None = None, keepdims: bool = False):
        self.inputs, self.output, self.axis, self.keepdims = (a,), output, axis, keepdims

    def length(self, a: Shape) -> int:
        return int(np.prod(a)) if self.axis is None else a[norm_axis(self.axis, len(a))]

    def infer(self, a: Shape) -> Shape:
        if self.axis is None:
            return (1,) * len(a) if self.keepdims else ()
        axis = norm_axis(self.axis, len(a))
        return a[:axis] + (1,) * self.keepdims + a[axis + 1 :]

    def lanes(self, lanes_: Column, n: int) -> Column:
        """One value for each lane."""
        raise NotImplementedError

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        shape = shapes[0]
        if shape == ():
            columns, shape = [F.array(columns[0])], (1,)
        axis = None if self.axis is None else norm_axis(self.axis, len(shape))
        values = self.lanes(t.lanes(columns[0], shape, axis), self.length(shape))
        return F.get(values, F.lit(0)) if self.infer(shapes[0]) == () else values


class Max(Reduction):
    def lanes(self, lanes_: Column, n: int) -> Column:
        return t.reduced(lanes_, t.largest)


class Min(Reduction):
    def lanes(self, lanes_: Column, n: int) -> Column:
        return t.reduced(lanes_, t.smallest)


class Sum(Reduction):
    """As a reduction of everything it gives one element, shape (1,)."""

    def infer(self, a: Shape) -> Shape:
        return super().infer(a) or (1,)

    def lanes(self, lanes_: Column, n: int) -> Column:
        return t.reduced(lanes_, t.total)


class Mean(Reduction):
    def lanes(self, lanes_: Column, n: int) -> Column:
        return t.reduced(lanes_, lambda x: t.total(x) / n)


class Var(Reduction):
    """Variance with n - ``ddof`` in the denominator."""

    def __init__(self, a: str, output: str, axis: int | None = None, ddof: int = 0, keepdims: bool = False):
        super().__init__(a, output, axis, keepdims)
        self.ddof = ddof

    def infer(self, a: Shape) -> Shape:
        if self.length(a or (1,)) <= self.ddof:
            raise ValueError("there must be more values than ddof")
        return super().infer(a)

    def lanes(self, lanes_: Column, n: int) -> Column:
        return t.variance(lanes_, self.ddof)


class Std(Var):
    def lanes(self, lanes_: Column, n: int) -> Column:
        return F.transform(t.variance(lanes_, self.ddof), F.sqrt)


def with_nan_policy(lanes_: Column, policy: str) -> Column:
    """``propagate`` leaves NaN in, ``omit`` takes it out, ``raise`` fails on it."""
    if policy == "propagate":
        return lanes_
    if policy == "omit":
        return F.transform(lanes_, lambda x: F.filter(x, lambda v: ~F.isnan(v)))
    if policy == "raise":
        bad = F.exists(lanes_, lambda x: F.exists(x, F.isnan))
        return F.when(bad, F.raise_error(F.lit("the input holds NaN"))).otherwise(lanes_)
    raise ValueError("nan_policy is propagate, omit or raise")


class Skewness(Reduction):
    """Third standardised moment; ``bias=False`` corrects for the sample."""

    def __init__(self, a: str, output: str, axis: int | None = None, keepdims: bool = False, bias: bool = True, nan_policy: str = "propagate"):
        super().__init__(a, output, axis, keepdims)
        self.bias, self.nan_policy = bias, nan_policy

    def lanes(self, lanes_: Column, n: int) -> Column:
        return t.skewness(with_nan_policy(lanes_, self.nan_policy), self.bias)


class Kurtosis(Reduction):
    """Fourth standardised moment, less 3 with ``fisher``; ``bias=False`` corrects for the sample."""

    def __init__(self, a: str, output: str, axis: int | None = None, keepdims: bool = False, bias: bool = True, fisher: bool = True, nan_policy: str = "propagate"):
        super().__init__(a, output, axis, keepdims)
        self.bias, self.fisher, self.nan_policy = bias, fisher, nan_policy

    def lanes(self, lanes_: Column, n: int) -> Column:
        return t.kurtosis(with_nan_policy(lanes_, self.nan_policy), self.bias, self.fisher)


class Slope(ColumnOperator):
    """Least-squares slope along ``axis`` against times from 0 to n / fs, the end included; the axis keeps length one."""

    def __init__(self, a: str, output: str, fs: float = 1.0, axis: int = -1):
        self.inputs, self.output, self.fs, self.axis = (a,), output, fs, axis

    def infer(self, a: Shape) -> Shape:
        axis = norm_axis(self.axis, len(a))
        if a[axis] < 2:
            raise ValueError("a slope needs two samples")
        return a[:axis] + a[axis + 1 :] + (1,)

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        axis = norm_axis(self.axis, len(shapes[0]))
        n = shapes[0][axis]
        time = np.linspace(0, n / self.fs, n)
        centred = time - time.mean()
        return F.transform(t.lanes(columns[0], shapes[0], axis), lambda x: t.dot(x, centred / (centred @ centred)))


class Covariance(BatchOperator):
    """(C + r I) / (1 + r) of each trial; rows are variables, columns observations. Rank 3 is a set of trials."""

    def __init__(self, a: str, output: str, regularization: float = 0.0):
        if not 0 <= regularization <= 1:
            raise ValueError("the regularisation lies between 0 and 1")
        self.inputs, self.output, self.r = (a,), output, regularization

    def infer(self, a: Shape) -> Shape:
        if not 1 <= len(a) <= 3:
            raise ValueError("covariance takes rank 1 to 3")
        if a[-1] < 2:
            raise ValueError("covariance needs two observations")
        return (1, 1) if len(a) == 1 else a[:-1] + (a[-2],)

    def batch(self, a: np.ndarray) -> np.ndarray:
        return spd.covariance(a[:, None, :] if a.ndim == 2 else a, self.r)
