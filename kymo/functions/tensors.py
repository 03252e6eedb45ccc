"""Catalyst expressions over tensor columns: element-wise maps with broadcasting, gathers, and reductions along an axis.

Doubles behave as in IEEE arithmetic, unlike Spark's own defaults: x / 0 is infinite or NaN instead of an error, the
logarithm of what isn't positive is NaN or minus infinity instead of null, comparisons with NaN are false.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
Shape = tuple[int, ...]


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """f(*values), each value evaluated once; null where any of them is.

    Catalyst writes an expression out wherever it is used, also inside a function that runs for every element. Here values
    are variables of an outer function over one element, so operators on operators cost the sum of their work.
    """
    fields = [f"v{i}" for i in range(len(values))]
    if len(values) == 1:
        once = F.transform(F.array(values[0]), lambda x: F.when(x.isNotNull(), f(x)))
    else:
        known = lambda s: F.greatest(*[s[n].isNull() for n in fields])
        once = F.transform(F.array(F.struct(*[v.alias(n) for v, n in zip(values, fields)])), lambda s: F.when(~known(s), f(*[s[n] for n in fields])))
    return F.get(once, F.lit(0))


# ---- element-wise ----


def unary(a: Column, shape: Shape, f: Callable[[Column], Column]) -> Column:
    return f(a) if shape == () else F.transform(a, f)


def broadcast_shape(a: Shape, b: Shape) -> Shape:
    try:
        return np.broadcast_shapes(a, b)
    except ValueError:
        raise ValueError(f"shapes {a} and {b} don't broadcast") from None


def binary(a: Column, a_shape: Shape, b: Column, b_shape: Shape, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` over two tensors; equal shapes and scalars need no index arithmetic."""
    if a_shape == b_shape:
        return f(a, b) if a_shape == () else F.zip_with(a, b, f)
    if a_shape == ():
        return bound(lambda u, v: F.transform(v, lambda x: f(u, x)), a, b)
    if b_shape == ():
        return bound(lambda u, v: F.transform(u, lambda x: f(x, v)), a, b)
    out = broadcast_shape(a_shape, b_shape)
    if a_shape != out:
        a = gather(a, np.broadcast_to(np.arange(int(np.prod(a_shape))).reshape(a_shape), out))
    if b_shape != out:
        b = gather(b, np.broadcast_to(np.arange(int(np.prod(b_shape))).reshape(b_shape), out))
    return F.zip_with(a, b, f)


def log(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.ln(x))


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def _no_nan(a: Column, b: Column) -> Column:
    return ~(F.isnan(a) | F.isnan(b))


def greater(a: Column, b: Column) -> Column:
    return _no_nan(a, b) & (a > b)


def less(a: Column, b: Column) -> Column:
    return _no_nan(a, b) & (a < b)


def equal(a: Column, b: Column) -> Column:
    return _no_nan(a, b) & (a == b)


def truth(a: Column) -> Column:
    return a != 0


def number(condition: Column) -> Column:
    """1.0 or 0.0; null stays null."""
    return condition.cast("double")


# ---- index arithmetic ----


def constant_ints(values: np.ndarray) -> Column:
    """array<int> of static numbers, as one text that Catalyst folds: a plan with many literals takes long to build."""
    return F.split(F.lit(",".join(map(str, np.asarray(values).ravel().tolist()))), ",").cast("array<int>") if np.size(values) else F.array().cast("array<int>")


def gather(a: Column, index: np.ndarray) -> Column:
    """The elements of ``a`` at static positions, in row-major order of ``index``."""
    flat = np.asarray(index).ravel()
    if len(flat) and np.array_equal(flat, np.arange(flat[0], flat[0] + len(flat))):
        return F.slice(a, int(flat[0]) + 1, len(flat))
    return bound(lambda x: F.transform(constant_ints(flat), lambda i: F.get(x, i)), a)


def lanes(a: Column, shape: Shape, axis: int | None) -> Column:
    """array<array<double>>: the values along ``axis`` for each place on the other axes; one lane for None."""
    if axis is None or len(shape) < 2:
        return F.array(a)
    outer, n, inner = int(np.prod(shape[:axis])), shape[axis], int(np.prod(shape[axis + 1 :]))
    if inner == 1:
        return bound(lambda x: F.transform(F.sequence(F.lit(0), F.lit(outer - 1)), lambda o: F.slice(x, o * n + 1, n)), a)
    places = F.sequence(F.lit(0), F.lit(outer * inner - 1))
    step = F.sequence(F.lit(0), F.lit(n - 1))

    def lane(x: Column, p: Column) -> Column:
        base = F.floor(p / inner) * (n * inner) + p % inner
        return F.transform(step, lambda k: F.get(x, (base + k * inner).cast("int")))

    return bound(lambda x: F.transform(places, lambda p: lane(x, p)), a)


# ---- reductions of one lane (array<double>) ----


def _any_nan(x: Column) -> Column:
    return F.exists(x, F.isnan)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def largest(x: Column) -> Column:
    return F.when(_any_nan(x), NAN).otherwise(F.array_max(x))


def smallest(x: Column) -> Column:
    return F.when(_any_nan(x), NAN).otherwise(F.array_min(x))


def dot(x: Column, weights: np.ndarray) -> Column:
    return total(F.zip_with(x, F.lit([float(w) for w in weights]), lambda v, w: v * w))


def reduced(lanes_: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(lanes_, f)


def central(lanes_: Column, powers: tuple[int, ...], finish: Callable[..., Column]) -> Column:
    """finish(n, sums of the given powers of the distance from the mean) for each lane, in two passes."""
    met = F.transform(lanes_, lambda x: F.struct(x.alias("x"), (total(x) / F.size(x)).alias("m")))
    sums = F.transform(met, lambda s: F.struct(
        F.size(s["x"]).cast("double").alias("n"),
        F.aggregate(
            s["x"], F.struct(*[F.lit(0.0).alias(f"p{p}") for p in powers]),
            lambda acc, v: F.struct(*[(acc[f"p{p}"] + _power(v - s["m"], p)).alias(f"p{p}") for p in powers])).alias("c")))
    return F.transform(sums, lambda s: finish(s["n"], *[s["c"][f"p{p}"] for p in powers]))


def _power(x: Column, p: int) -> Column:
    return x if p == 1 else x * _power(x, p - 1)


def variance(lanes_: Column, ddof: int) -> Column:
    return central(lanes_, (2,), lambda n, s2: divide(s2, n - ddof))


def skewness(lanes_: Column, bias: bool) -> Column:
    def finish(n: Column, s2: Column, s3: Column) -> Column:
        g = divide(s3 / n, F.pow(s2 / n, F.lit(1.5)))
        return g if bias else F.when(n > 2, g * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).otherwise(g)

    return central(lanes_, (2, 3), finish)


def kurtosis(lanes_: Column, bias: bool, fisher: bool) -> Column:
    def finish(n: Column, s2: Column, s4: Column) -> Column:
        g = divide(s4 / n, (s2 / n) * (s2 / n)) - 3
        if not bias:
            corrected = ((n + 1) * g + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
            g = F.when(n > 3, corrected).otherwise(g)
        return g if fisher else g + 3

    return central(lanes_, (2, 4), finish)
