"""Digital filters and resampling of a trial's signal; designs happen once, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from kymo.numerics import fir as fir_design
from kymo.numerics import iir
from kymo.operators.base import BatchOperator, Shape, norm_axis

IMPLEMENTATIONS = ("ba", "zpk", "sos", "fir")


@dataclass(frozen=True)
class FilterDesign:
    """Coefficients of a filter: (b, a), zeros-poles-gain, sections, or taps."""

    kind: str
    coefficients: object

    @classmethod
    def _recursive(cls, proto: iir.Zpk, edges, btype: str, implementation: str, fs: float) -> FilterDesign:
        if implementation not in IMPLEMENTATIONS[:3]:
            raise ValueError("implementation is ba, zpk or sos")
        zpk = iir.digital(proto, edges, btype, fs)
        made = {"ba": iir.transfer, "sos": iir.sections, "zpk": lambda x: x}[implementation](zpk)
        return cls(implementation, made)

    @classmethod
    def butter(cls, order: int, edges, btype: str = "lowpass", implementation: str = "ba", fs: float = 1.0) -> FilterDesign:
        return cls._recursive(iir.butterworth(order), edges, btype, implementation, fs)

    @classmethod
    def cheby1(cls, order: int, ripple_db: float, edges, btype: str = "lowpass", implementation: str = "ba", fs: float = 1.0) -> FilterDesign:
        return cls._recursive(iir.chebyshev1(order, ripple_db), edges, btype, implementation, fs)

    @classmethod
    def cheby2(cls, order: int, stop_db: float, edges, btype: str = "lowpass", implementation: str = "ba", fs: float = 1.0) -> FilterDesign:
        return cls._recursive(iir.chebyshev2(order, stop_db), edges, btype, implementation, fs)

    @classmethod
    def ellip(cls, order: int, ripple_db: float, stop_db: float, edges, btype: str = "lowpass", implementation: str = "ba", fs: float = 1.0) -> FilterDesign:
        return cls._recursive(iir.elliptic(order, ripple_db, stop_db), edges, btype, implementation, fs)

    @classmethod
    def bessel(cls, order: int, edges, btype: str = "lowpass", implementation: str = "ba", fs: float = 1.0, norm: str = "phase") -> FilterDesign:
        return cls._recursive(iir.bessel(order, norm), edges, btype, implementation, fs)

    @classmethod
    def fir(cls, fs: float, low: float | None = None, high: float | None = None, length: int | str = "auto", low_width: float | str = "auto",
            high_width: float | str = "auto", phase: str = "zero", window: str = "hamming", design: str = "firwin",
            method: str = "fir", iir_params: dict | None = None) -> FilterDesign:
        """Taps; with ``method="iir"`` a recursive design for the same band: ``iir_params`` has order (4), kind (butter, cheby1,
        cheby2, ellip or bessel), output (sos) and what else that kind takes, such as ripple_db."""
        if method == "fir":
            return cls("fir", fir_design.design(fs, low, high, length, low_width, high_width, phase, window, design))
        if method != "iir":
            raise ValueError("method is fir or iir")
        options = {"order": 4, "kind": "butter", "output": "sos"} | (iir_params or {})
        order, kind, output = (options.pop(k) for k in ("order", "kind", "output"))
        if kind not in ("butter", "cheby1", "cheby2", "ellip", "bessel"):
            raise ValueError(f"there is no recursive design {kind}")
        if low is None and high is None:
            raise ValueError("at least one edge is needed")
        btype = "lowpass" if low is None else "highpass" if high is None else "bandpass" if low < high else "bandstop"
        edges = high if low is None else low if high is None else (min(low, high), max(low, high))
        return getattr(cls, kind)(order, edges=edges, btype=btype, implementation=output, fs=fs, **options)


class _Filtering(BatchOperator):
    def __init__(self, a: str, design: FilterDesign, output: str, axis: int = 1):
        if design.kind == "zpk":
            raise ValueError("zeros, poles and gain can't filter; take ba or sos")
        self.inputs, self.output, self.design, self.axis = (a,), output, design, axis

    def infer(self, a: Shape) -> Shape:
        norm_axis(self.axis, len(a))
        return a

    def run(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def batch(self, a: np.ndarray) -> np.ndarray:
        axis = norm_axis(self.axis, a.ndim - 1) + 1  # the first axis counts trials
        return np.moveaxis(self.run(np.moveaxis(a, axis, -1)), -1, axis)


class Filter(_Filtering):
    """Causal filter; every trial starts at rest."""

    def run(self, x: np.ndarray) -> np.ndarray:
        c = self.design.coefficients
        if self.design.kind == "sos":
            return iir.sosfilt(c, x)
        return iir.lfilter(*c, x) if self.design.kind == "ba" else iir.lfilter(c, np.ones(1), x)


class FiltFilt(_Filtering):
    """Forward-backward filter without phase, for recursive designs."""

    def __init__(self, a: str, design: FilterDesign, output: str, axis: int = 1):
        if design.kind == "fir":
            raise TypeError("forward-backward filtering takes ba or sos designs")
        super().__init__(a, design, output, axis)

    def infer(self, a: Shape) -> Shape:
        n = a[norm_axis(self.axis, len(a))]
        self.run(np.zeros((1, n)))  # too short a signal raises here
        return a

    def run(self, x: np.ndarray) -> np.ndarray:
        c = self.design.coefficients
        return iir.sosfiltfilt(c, x) if self.design.kind == "sos" else iir.filtfilt(*c, x)


class Resample(BatchOperator):
    """Fourier resampling to ceil(n * factor) samples along ``axis``."""

    def __init__(self, a: str, factor: float, output: str, axis: int = 1):
        if factor <= 0:
            raise ValueError("the factor is positive")
        self.inputs, self.output, self.factor, self.axis = (a,), output, factor, axis

    def infer(self, a: Shape) -> Shape:
        axis = norm_axis(self.axis, len(a))
        return a[:axis] + (int(np.ceil(a[axis] * self.factor)),) + a[axis + 1 :]

    def batch(self, a: np.ndarray) -> np.ndarray:
        return fir_design.resample(a, self.factor, norm_axis(self.axis, a.ndim - 1) + 1)
