"""Recursive digital filters: analog prototypes, band transformations, the bilinear map, and sample recurrences.

Written from the literature: Oppenheim & Schafer for Butterworth and Chebyshev prototypes and the bilinear map,
Orfanidis' lecture notes for elliptic filters by Landen transformations, reverse Bessel polynomials for Bessel filters,
Gustafsson (1996) for the start of forward-backward filtering.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

BAND_TYPES = ("lowpass", "highpass", "bandpass", "bandstop")


@dataclass(frozen=True)
class Zpk:
    """Zeros, poles and gain."""

    z: np.ndarray
    p: np.ndarray
    k: float


# ---- analog low-pass prototypes with cut-off 1 rad/s ----


def butterworth(order: int) -> Zpk:
    k = np.arange(1, order + 1)
    return Zpk(np.empty(0, complex), np.exp(1j * math.pi * (2 * k + order - 1) / (2 * order)), 1.0)


def chebyshev1(order: int, ripple_db: float) -> Zpk:
    eps = math.sqrt(10 ** (ripple_db / 10) - 1)
    mu, theta = math.asinh(1 / eps) / order, math.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    p = -math.sinh(mu) * np.sin(theta) + 1j * math.cosh(mu) * np.cos(theta)
    gain = np.prod(-p).real
    return Zpk(np.empty(0, complex), p, gain if order % 2 else gain / math.sqrt(1 + eps * eps))


def chebyshev2(order: int, stop_db: float) -> Zpk:
    eps = 1 / math.sqrt(10 ** (stop_db / 10) - 1)
    mu, theta = math.asinh(1 / eps) / order, math.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    p = 1 / (-math.sinh(mu) * np.sin(theta) + 1j * math.cosh(mu) * np.cos(theta))
    cosines = np.cos(theta)
    z = 1j / cosines[np.abs(cosines) > 1e-12]
    return Zpk(z, p, (np.prod(-p) / np.prod(-z)).real)


def _landen(k: float) -> list[float]:
    """Descending Landen moduli until they vanish."""
    out = []
    while k > 1e-16 and len(out) < 12:
        k = (k / (1 + math.sqrt(max(0.0, 1 - k * k)))) ** 2
        out.append(k)
    return out


def _ascend(w, moduli: list[float]):
    for v in reversed(moduli):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _cd(u, k: float):
    """Jacobi cd(u K, k) for complex u in units of the quarter period."""
    return _ascend(np.cos(np.asarray(u, complex) * math.pi / 2), _landen(k))


def _sn(u, k: float):
    return _ascend(np.sin(np.asarray(u, complex) * math.pi / 2), _landen(k))


def _inverse_sn(w: complex, k: float) -> complex:
    moduli = [k, *_landen(k)]
    for before, v in zip(moduli, moduli[1:]):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (before * w) ** 2 + 0j)))
    return 1 - 2 / math.pi * np.arccos(w + 0j)


def elliptic(order: int, ripple_db: float, stop_db: float) -> Zpk:
    eps_p, eps_s = math.sqrt(10 ** (ripple_db / 10) - 1), math.sqrt(10 ** (stop_db / 10) - 1)
    if order == 1:
        return chebyshev1(1, ripple_db)
    k1 = eps_p / eps_s
    pairs, odd = order // 2, order % 2
    u = (2 * np.arange(1, pairs + 1) - 1) / order
    k1_c = math.sqrt(1 - k1 * k1)
    k_c = k1_c**order * float(np.prod(_sn(u, k1_c).real)) ** 4  # degree equation
    k = math.sqrt(1 - k_c * k_c)
    z = 1j / (k * _cd(u, k))
    v0 = -1j * _inverse_sn(1j / eps_p, k1) / order
    p = 1j * _cd(u - 1j * v0, k)
    z, p = np.concatenate([z, z.conj()]), np.concatenate([p, p.conj()])
    if odd:
        p = np.append(p, (1j * _sn(1j * v0, k)).real)
    gain = (np.prod(-p) / np.prod(-z)).real
    return Zpk(z, p, gain if odd else gain / math.sqrt(1 + eps_p * eps_p))


def bessel(order: int, norm: str = "phase") -> Zpk:
    coefficients = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k)) for k in range(order, -1, -1)]
    p = np.roots(coefficients).astype(complex)
    if norm == "phase":
        p = p / coefficients[-1] ** (1 / order)
    elif norm == "mag":
        gain = np.prod(-p)
        low, high = 0.0, 10.0 * order
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if abs(gain / np.prod(1j * middle - p)) > math.sqrt(0.5) else (low, middle)
        p = p / low
    elif norm != "delay":
        raise ValueError("norm is phase, mag or delay")
    return Zpk(np.empty(0, complex), p, np.prod(-p).real)


# ---- band transformations and the bilinear map ----


def to_band(proto: Zpk, band: str, edges: list[float]) -> Zpk:
    """Analog filter with the given edges (rad/s) from a prototype."""
    more = len(proto.p) - len(proto.z)
    if band == "lowpass":
        w = edges[0]
        return Zpk(proto.z * w, proto.p * w, proto.k * w**more)
    if band == "highpass":
        w = edges[0]
        gain = proto.k * (np.prod(-proto.z) / np.prod(-proto.p)).real
        return Zpk(np.append(w / proto.z, np.zeros(more)), w / proto.p, gain)
    width, center2 = edges[1] - edges[0], edges[0] * edges[1]

    def split(x: np.ndarray) -> np.ndarray:
        half = x / 2
        root = np.sqrt(half * half - center2 + 0j)
        return np.concatenate([half + root, half - root])

    if band == "bandpass":
        return Zpk(np.append(split(proto.z * width), np.zeros(more)), split(proto.p * width), proto.k * width**more)
    if band == "bandstop":
        gain = proto.k * (np.prod(-proto.z) / np.prod(-proto.p)).real
        notch = np.concatenate([np.full(more, 1j), np.full(more, -1j)]) * math.sqrt(center2)
        return Zpk(np.append(split(width / proto.z), notch), split(width / proto.p), gain)
    raise ValueError(f"band type is one of {BAND_TYPES}")


def bilinear(analog: Zpk, fs: float) -> Zpk:
    two = 2 * fs
    more = len(analog.p) - len(analog.z)
    gain = analog.k * (np.prod(two - analog.z) / np.prod(two - analog.p)).real
    return Zpk(np.append((two + analog.z) / (two - analog.z), -np.ones(more)), (two + analog.p) / (two - analog.p), gain)


def digital(proto: Zpk, edges: float | tuple[float, float], band: str, fs: float) -> Zpk:
    """Digital filter; edges in the unit of ``fs``."""
    f = [float(x) for x in np.atleast_1d(edges)]
    if len(f) != (2 if band.startswith("band") else 1):
        raise ValueError("band filters take two edges, others one")
    if any(not 0 < x < fs / 2 for x in f) or f != sorted(f):
        raise ValueError("edges must rise between 0 and half of fs")
    return bilinear(to_band(proto, band, [2 * fs * math.tan(math.pi * x / fs) for x in f]), fs)


def transfer(zpk: Zpk) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator."""
    return (zpk.k * np.poly(zpk.z)).real, np.poly(zpk.p).real


def sections(zpk: Zpk) -> np.ndarray:
    """Second-order sections: the pole pair nearest the unit circle takes its nearest zeros and comes last."""

    def pairs(roots: np.ndarray) -> list[list[complex]]:
        upper = [r for r in roots if r.imag > 1e-10]
        real = sorted((r.real for r in roots if abs(r.imag) <= 1e-10), key=lambda r: (abs(r), r))
        out = [[r, r.conjugate()] for r in upper]
        while real:
            out.append([complex(real.pop()) for _ in range(min(2, len(real)))])
        return out

    count = -(-max(len(zpk.p), len(zpk.z)) // 2)
    poles = sorted(pairs(zpk.p), key=lambda ps: -max(map(abs, ps)))
    zeros = pairs(zpk.z)
    out = []
    for ps in poles + [[]] * (count - len(poles)):
        at = min(range(len(zeros)), key=lambda i: abs(zeros[i][0] - ps[0]) if ps else 0, default=None)
        zs = zeros.pop(at) if at is not None else []
        b, a = np.poly(zs).real if zs else np.ones(1), np.poly(ps).real if ps else np.ones(1)
        out.append(np.concatenate([np.pad(np.atleast_1d(b), (0, 3 - np.size(b))), np.pad(np.atleast_1d(a), (0, 3 - np.size(a)))]))
    out.reverse()
    sos = np.array(out)
    sos[0, :3] *= zpk.k
    return sos


def response(b: np.ndarray, a: np.ndarray, f: np.ndarray, fs: float) -> np.ndarray:
    """Complex gain at frequencies ``f``."""
    z = np.exp(-2j * math.pi * np.asarray(f) / fs)
    return np.polyval(b[::-1], z) / np.polyval(a[::-1], z)


# ---- filtering: time is the last axis, all others run at once ----


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Transposed direct form II from state zero (or ``state``, of shape (..., n)). No denominator: a convolution."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    n = max(len(a), len(b))
    if len(a) == 1 and state is None:
        size = x.shape[-1]
        out = np.zeros(x.shape)
        for k in range(min(len(b), size)):
            out[..., k:] += b[k] * x[..., : size - k]
        return out
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    z = np.zeros((n, *x.shape[:-1]))
    if state is not None:
        z[: n - 1] = np.moveaxis(state, -1, 0)
    out, rows = np.empty(x.shape), np.moveaxis(x, -1, 0)
    column = (slice(None), *[None] * (x.ndim - 1))
    b_rest, a_rest = b[1:][column], a[1:][column]
    for t, v in enumerate(rows):
        y = b[0] * v + z[0]
        z[:-1] = z[1:] + b_rest * v - a_rest * y
        out[..., t] = y
    return out


def sosfilt(sos: np.ndarray, x: np.ndarray, states: list[np.ndarray] | None = None) -> np.ndarray:
    for i, s in enumerate(sos):
        x = lfilter(s[:3], s[3:], x, None if states is None else states[i])
    return x


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State in which a unit step leaves the filter at rest."""
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
    if n == 1:
        return np.zeros(0)
    gain = b.sum() / a.sum()
    # state i holds what later taps still owe: z_i = sum over j > i of (b_j - a_j * gain)
    return np.cumsum((b - a * gain)[:0:-1])[::-1]


def extended(x: np.ndarray, n: int) -> np.ndarray:
    """Odd extension by ``n`` samples on both sides."""
    if n >= x.shape[-1]:
        raise ValueError(f"forward-backward filtering needs more than {n} samples")
    if not n:
        return x
    return np.concatenate([2 * x[..., :1] - x[..., n:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -n - 2 : -1]], axis=-1)


def _twice(run, x: np.ndarray, n: int) -> np.ndarray:
    y = extended(x, n)
    for _ in range(2):
        y = run(y)[..., ::-1]
    return y[..., n : y.shape[-1] - n]


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    zi = steady_state(b, a)
    return _twice(lambda y: lfilter(b, a, y, y[..., :1] * zi), x, 3 * max(len(a), len(b)))


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    start, gain = [], 1.0
    for s in sos:
        start.append(gain * steady_state(s[:3], s[3:]))
        gain *= s[:3].sum() / s[3:].sum()
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    return _twice(lambda y: sosfilt(sos, y, [y[..., :1] * z for z in start]), x, int(3 * taps))
