"""Geometry of symmetric positive definite matrices (Moakher 2005, Pennec et al. 2006, Barachant et al. 2012).

All functions take stacks of matrices (..., n, n); functions of matrices go by eigenvalues.
"""

from __future__ import annotations

import math

import numpy as np


def _apply(c: np.ndarray, f) -> np.ndarray:
    values, vectors = np.linalg.eigh(c)
    return (vectors * f(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def _positive(values: np.ndarray) -> np.ndarray:
    if np.any(values <= 0):
        raise np.linalg.LinAlgError("a matrix isn't positive definite")
    return values


def sqrtm(c: np.ndarray) -> np.ndarray:
    return _apply(c, lambda v: np.sqrt(_positive(v)))


def invsqrtm(c: np.ndarray) -> np.ndarray:
    return _apply(c, lambda v: 1 / np.sqrt(_positive(v)))


def logm(c: np.ndarray) -> np.ndarray:
    return _apply(c, lambda v: np.log(_positive(v)))


def expm(c: np.ndarray) -> np.ndarray:
    return _apply(c, np.exp)


def powm(c: np.ndarray, power: float) -> np.ndarray:
    return _apply(c, lambda v: _positive(v) ** power)


def regularise(c: np.ndarray, r: float) -> np.ndarray:
    """(1 - r) C + r I."""
    return (1 - r) * c + r * np.eye(c.shape[-1])


def covariance(x: np.ndarray, r: float = 0.0) -> np.ndarray:
    """(C + r I) / (1 + r) of trials (..., variables, observations), with n - 1 in the denominator."""
    if not 0 <= r <= 1:
        raise ValueError("the regularisation lies between 0 and 1")
    centred = x - x.mean(axis=-1, keepdims=True)
    c = centred @ np.swapaxes(centred, -1, -2) / (x.shape[-1] - 1)
    return (c + r * np.eye(c.shape[-1])) / (1 + r)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Affine-invariant distance, with broadcasting over stacks."""
    w = invsqrtm(a)
    return np.sqrt((np.log(_positive(np.linalg.eigvalsh(w @ b @ w))) ** 2).sum(axis=-1))


def geodesic(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """The point at ``alpha`` on the way from a (0) to b (1)."""
    root, inverse = sqrtm(a), invsqrtm(a)
    return root @ powm(inverse @ b @ inverse, alpha) @ root


def tangent(c: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Upper triangle of log(M^-1/2 C M^-1/2), row by row, with off-diagonals times sqrt 2."""
    w = invsqrtm(reference)
    s = logm(w @ c @ w)
    rows, cols = np.triu_indices(c.shape[-1])
    return s[..., rows, cols] * np.where(rows == cols, 1.0, math.sqrt(2))


def from_tangent(vectors: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Inverse of ``tangent``."""
    n = reference.shape[-1]
    rows, cols = np.triu_indices(n)
    s = np.zeros((*vectors.shape[:-1], n, n))
    s[..., rows, cols] = vectors / np.where(rows == cols, 1.0, math.sqrt(2))
    s[..., cols, rows] = s[..., rows, cols]
    root = sqrtm(reference)
    return root @ expm(s) @ root


class KarcherStep:
    """State of the gradient flow for the mean: hand each step the weighted mean of logs, J, at ``at``."""

    def __init__(self, start: np.ndarray, tolerance: float = 1e-8, most: int = 50):
        self.at, self.tolerance, self.left = start, tolerance, most
        self.step, self.last, self.done = 1.0, math.inf, False

    def whitener(self) -> np.ndarray:
        return invsqrtm(self.at)

    def advance(self, j: np.ndarray) -> None:
        size = float(np.linalg.norm(j))
        root = sqrtm(self.at)
        self.at = root @ expm(self.step * j) @ root
        self.left -= 1
        if size < self.last:
            self.step, self.last = 0.95 * self.step, size
        else:
            self.step *= 0.5
        self.done = size < self.tolerance or self.step < 1e-12 or self.left <= 0


def mean(c: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Frechet mean of a stack (m, n, n) by the Karcher flow."""
    w = np.full(len(c), 1 / len(c)) if weights is None else np.asarray(weights, float) / np.sum(weights)
    flow = KarcherStep(np.einsum("m,mij->ij", w, c))
    while not flow.done:
        inverse = flow.whitener()
        flow.advance(np.einsum("m,mij->ij", w, logm(inverse @ c @ inverse)))
    return flow.at
