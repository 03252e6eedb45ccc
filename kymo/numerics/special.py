"""Distribution functions (Abramowitz & Stegun 6.5 and 7.1)."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_cdf(x: np.ndarray, loc: float = 0.0, scale: float = 1.0) -> np.ndarray:
    return 0.5 * _erfc(-(np.asarray(x, float) - loc) / (scale * math.sqrt(2)))


def lower_gamma(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x): a series below a + 1, a continued fraction above."""
    x = np.asarray(x, float)
    out = np.where(np.isnan(x), np.nan, np.where(np.isinf(x) & (x > 0), 1.0, 0.0))
    factor = lambda v: np.exp(a * np.log(v) - v - math.lgamma(a))
    small = (x > 0) & (x < a + 1)
    if small.any():
        v = x[small]
        term = total = np.full(v.shape, 1 / a)
        n = a
        while True:
            n += 1
            term = term * v / n
            total = total + term
            if np.all(np.abs(term) <= 1e-17 * total):
                break
        out[small] = total * factor(v)
    large = (x >= a + 1) & np.isfinite(x)
    if large.any():
        v = x[large]
        b = v + 1 - a
        c, d = np.full(v.shape, 1e300), 1 / b
        h = d
        for i in range(1, 10_000):  # modified Lentz
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[large] = 1 - h * factor(v)
    return out


def chi2_cdf(x: np.ndarray, df: float, loc: float = 0.0, scale: float = 1.0) -> np.ndarray:
    if df <= 0:
        raise ValueError("degrees of freedom are positive")
    return lower_gamma(df / 2, np.atleast_1d((np.asarray(x, float) - loc) / scale / 2)).reshape(np.shape(x))
