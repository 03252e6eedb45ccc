"""Windowed-sinc filters and Fourier resampling."""

from __future__ import annotations

import math

import numpy as np

# Coefficients of the cosine windows (Oppenheim & Schafer), and the transition width of each, in
# multiples of fs / length.
WINDOWS = {"hamming": ((0.54, 0.46), 3.3), "hann": ((0.5, 0.5), 3.1), "blackman": ((0.42, 0.5, 0.08), 5.0), "boxcar": ((1.0,), 0.9)}


def window(name: str, n: int) -> np.ndarray:
    """Symmetric cosine window."""
    t = 2 * math.pi * np.arange(n) / max(1, n - 1)
    return sum((-1) ** k * c * np.cos(k * t) for k, c in enumerate(WINDOWS[name][0]))


def low_pass(cut: float, n: int, name: str) -> np.ndarray:
    """Windowed sinc with unit gain at 0; ``cut`` as a share of fs."""
    t = np.arange(n) - (n - 1) / 2
    h = 2 * cut * np.sinc(2 * cut * t) * window(name, n)
    return h / h.sum()


def transition(low: float | None, high: float | None, fs: float) -> tuple[float, float]:
    """Default widths of the transitions: a quarter of the edge, 2 Hz at least, and no further than 0 or half of fs."""
    lower = min(max(0.25 * low, 2.0), low) if low else math.inf
    upper = min(max(0.25 * high, 2.0), fs / 2 - high) if high else math.inf
    return lower, upper


def design(fs: float, low: float | None, high: float | None, length: int | str = "auto", low_width: float | str = "auto", high_width: float | str = "auto", phase: str = "zero", name: str = "hamming",
           method: str = "firwin") -> np.ndarray:
    """Taps for a pass band from ``low`` to ``high``; one may be None; low above high makes it a stop band.

    ``firwin`` windows the difference of sincs, ``firwin2`` the inverse transform of the response with straight transitions.
    """
    if method not in ("firwin", "firwin2"):
        raise ValueError("the design is firwin or firwin2")
    if low is None and high is None:
        raise ValueError("at least one edge is needed")
    if name not in WINDOWS:
        raise ValueError(f"window is one of {sorted(WINDOWS)}")
    for edge in (low, high):
        if edge is not None and not 0 < edge < fs / 2:
            raise ValueError("edges must lie between 0 and half of fs")
    stop = low is not None and high is not None and low > high
    first, second = (high, low) if stop else (low, high)
    auto = transition(first, second, fs)
    w1, w2 = (auto[i] if w == "auto" else float(w) for i, w in enumerate((low_width, high_width)))
    n = int(math.ceil(WINDOWS[name][1] * fs / min(w1, w2))) if length == "auto" else int(length)
    n += 1 - n % 2  # odd: a whole delay, and any band is possible
    side = -1 if stop else 1
    if method == "firwin2":
        h = sampled(fs, first, second, w1, w2, stop, n, name)
        return h if phase == "zero" else minimum_phase(h) if phase == "minimum" else _unknown(phase)
    impulse = np.zeros(n)
    impulse[n // 2] = 1
    below = low_pass((first - side * w1 / 2) / fs, n, name) if first else np.zeros(n)
    upto = low_pass(min(second + side * w2 / 2, fs / 2 * (1 - 1e-9)) / fs, n, name) if second else impulse
    h = upto - below
    if stop:
        h = impulse - h
    if phase == "zero":
        return h
    if phase == "minimum":
        return minimum_phase(h)
    return _unknown(phase)


def _unknown(phase: str) -> np.ndarray:
    raise ValueError("phase is zero or minimum")


def sampled(fs: float, first: float | None, second: float | None, w1: float, w2: float, stop: bool, n: int, name: str) -> np.ndarray:
    """Taps by frequency sampling: the wanted response, straight within the transitions, transformed back and windowed."""
    m = 1 + (1 << max(9, int(n).bit_length()))
    f = np.linspace(0, fs / 2, m)
    side = -1 if stop else 1

    def step(edge: float | None, width: float, rising: int) -> np.ndarray:
        """0 to 1 over the transition outside of (rising 1) or inside of (-1) an edge."""
        if edge is None:
            return np.ones(m) if rising > 0 else np.zeros(m)
        low, high = (edge - width, edge) if rising * side > 0 else (edge, edge + width)
        return np.clip((f - low) / max(high - low, 1e-12), 0, 1)

    gain = step(first, w1, 1) - step(second, w2, -1)
    if stop:
        gain = 1 - gain
    shifted = gain * np.exp(-1j * math.pi * (n - 1) * f / fs)
    return np.fft.irfft(shifted)[:n] * window(name, n)


def minimum_phase(h: np.ndarray) -> np.ndarray:
    """Taps with the same magnitude and all zeros inside the unit circle (folded cepstrum)."""
    n = 1 << int(math.ceil(math.log2(max(64, 16 * len(h)))))
    magnitude = np.abs(np.fft.fft(h, n))
    cepstrum = np.fft.ifft(np.log(np.maximum(magnitude, 1e-8 * magnitude.max()))).real
    fold = np.zeros(n)
    fold[0], fold[1 : n // 2], fold[n // 2] = 1, 2, 1
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real[: len(h)]


def resample(x: np.ndarray, factor: float, axis: int) -> np.ndarray:
    """Fourier interpolation to ceil(n * factor) samples along ``axis``."""
    n = x.shape[axis]
    m = int(math.ceil(n * factor))
    if m < 1:
        raise ValueError("the factor leaves no sample")
    spectrum = np.moveaxis(np.fft.rfft(x, axis=axis), axis, -1)
    least = min(n, m)
    kept = np.zeros((*spectrum.shape[:-1], m // 2 + 1), complex)
    kept[..., : least // 2 + 1] = spectrum[..., : least // 2 + 1]
    if least % 2 == 0 and m != n:
        kept[..., least // 2] *= 2 if m < n else 0.5
    return np.moveaxis(np.fft.irfft(kept, m, axis=-1) * (m / n), -1, axis)
