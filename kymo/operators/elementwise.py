"""Arithmetic, logic, comparison, threshold and distribution functions, element by element."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kymo.functions import tensors as t
from kymo.numerics import special
from kymo.operators.base import BatchOperator, ColumnOperator, Shape


class Unary(ColumnOperator):
    """A function of each element."""

    function: Callable[[Column], Column]

    def __init__(self, a: str, output: str):
        self.inputs, self.output = (a,), output

    def infer(self, a: Shape) -> Shape:
        return a

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        return t.unary(columns[0], shapes[0], type(self).function)


class Binary(ColumnOperator):
    """A function of two elements, with numpy's broadcasting."""

    function: Callable[[Column, Column], Column]

    def __init__(self, a: str, b: str, output: str):
        self.inputs, self.output = (a, b), output

    def infer(self, a: Shape, b: Shape) -> Shape:
        return t.broadcast_shape(a, b)

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        return t.binary(columns[0], shapes[0], columns[1], shapes[1], type(self).function)


class Absolute(Unary):
    function = staticmethod(F.abs)


class Log(Unary):
    """Natural logarithm: NaN below zero, minus infinity at zero."""

    function = staticmethod(t.log)


class Add(Binary):
    function = staticmethod(lambda a, b: a + b)


class Subtract(Binary):
    function = staticmethod(lambda a, b: a - b)


class Multiply(Binary):
    function = staticmethod(lambda a, b: a * b)


class Divide(Binary):
    """True division; x / 0 is infinite, 0 / 0 is NaN."""

    function = staticmethod(t.divide)


class Not(Unary):
    """1 where an element is 0. Like all predicates it gives 1.0 and 0.0; NaN counts as true."""

    function = staticmethod(lambda a: t.number(~t.truth(a)))


class And(Binary):
    function = staticmethod(lambda a, b: t.number(t.truth(a) & t.truth(b)))


class Or(Binary):
    function = staticmethod(lambda a, b: t.number(t.truth(a) | t.truth(b)))


class Xor(Binary):
    function = staticmethod(lambda a, b: t.number(t.truth(a) != t.truth(b)))


class Greater(Binary):
    function = staticmethod(lambda a, b: t.number(t.greater(a, b)))


class Less(Binary):
    function = staticmethod(lambda a, b: t.number(t.less(a, b)))


class Equal(Binary):
    function = staticmethod(lambda a, b: t.number(t.equal(a, b)))


class Threshold(ColumnOperator):
    """1 where an element is above ``threshold``, a number or a scalar column."""

    def __init__(self, a: str, threshold: float | str, output: str):
        self.threshold = threshold
        self.inputs, self.output = (a, threshold) if isinstance(threshold, str) else (a,), output

    def infer(self, a: Shape, limit: Shape = ()) -> Shape:
        if limit != ():
            raise ValueError("the threshold is a scalar")
        return a

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        limit = columns[1] if len(columns) > 1 else F.lit(float(self.threshold))
        return t.unary(columns[0], shapes[0], lambda x: t.number(t.greater(x, limit)))


class Cdf(BatchOperator):
    """Distribution function of the normal (``norm``) or chi-square (``chi2``, with ``df``) distribution."""

    def __init__(self, a: str, output: str, dist: str = "norm", df: float | None = None, loc: float = 0.0, scale: float = 1.0):
        if dist not in ("norm", "chi2"):
            raise ValueError("dist is norm or chi2")
        if dist == "chi2" and df is None:
            raise ValueError("chi2 needs df")
        self.inputs, self.output = (a,), output
        self.dist, self.df, self.loc, self.scale = dist, df, loc, scale

    def infer(self, a: Shape) -> Shape:
        return a

    def batch(self, a: np.ndarray) -> np.ndarray:
        if self.dist == "norm":
            return special.normal_cdf(a, self.loc, self.scale)
        return special.chi2_cdf(a, self.df, self.loc, self.scale)
