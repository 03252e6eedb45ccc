"""Numerics against definitions, invariants and published values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kymo.numerics import fir, iir, learn, spd, special


def gain(zpk, f, fs):
    z = np.exp(2j * math.pi * np.asarray(f) / fs)
    return np.array([zpk.k * np.prod(x - zpk.z) / np.prod(x - zpk.p) for x in np.atleast_1d(z)])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("band,edges", [("lowpass", 20), ("highpass", 20), ("bandpass", (8, 35)), ("bandstop", (8, 35))])
def test_butterworth_edges(order, band, edges):
    z = iir.digital(iir.butterworth(order), edges, band, 250.0)
    assert np.all(np.abs(z.p) < 1)
    np.testing.assert_allclose(np.abs(gain(z, edges, 250.0)), math.sqrt(0.5), rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 6])
def test_chebyshev1_ripple(order):
    z = iir.digital(iir.chebyshev1(order, 1.0), 20, "lowpass", 100.0)
    g = np.abs(gain(z, np.linspace(0, 20, 2001), 100.0))
    assert np.all(np.abs(z.p) < 1)
    assert g.max() == pytest.approx(1, abs=1e-6) and g.min() == pytest.approx(10 ** (-1 / 20), abs=1e-6)


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_chebyshev2_stop(order):
    z = iir.digital(iir.chebyshev2(order, 40.0), 20, "lowpass", 100.0)
    g = np.abs(gain(z, np.linspace(20, 49.9, 3001), 100.0))
    assert g.max() == pytest.approx(0.01, rel=1e-4)
    assert abs(gain(z, 0, 100.0)[0]) == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3, 4, 5, 6])
def test_elliptic_ripple_and_stop(order):
    proto = iir.elliptic(order, 1.0, 40.0)
    w = np.linspace(0, 1, 4001)
    h = np.abs([proto.k * np.prod(1j * x - proto.z) / np.prod(1j * x - proto.p) for x in w])
    assert h.max() == pytest.approx(1, abs=1e-6) and h.min() == pytest.approx(10 ** (-1 / 20), abs=1e-5)
    far = np.abs([proto.k * np.prod(1j * x - proto.z) / np.prod(1j * x - proto.p) for x in np.geomspace(1, 1e4, 20001)])
    first = int(np.argmax(far <= 0.01))
    assert far[first:].max() <= 0.01 * (1 + 1e-6) and far[first:].max() == pytest.approx(0.01, rel=1e-2)


def test_bessel_norms():
    for norm in ("phase", "delay", "mag"):
        p = iir.bessel(4, norm)
        assert abs(p.k / np.prod(-p.p)) == pytest.approx(1)
        assert np.all(p.p.real < 0)
    m = iir.bessel(5, "mag")
    assert abs(m.k / np.prod(1j - m.p)) == pytest.approx(math.sqrt(0.5))
    d = iir.bessel(3, "delay")  # unit delay at 0
    phase = lambda w: np.angle(d.k / np.prod(1j * w - d.p))
    assert -(phase(1e-4) - phase(-1e-4)) / 2e-4 == pytest.approx(1, rel=1e-6)


def direct(b, a, x):
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
    return y / a[0]


def test_filters_follow_the_difference_equation():
    x = np.random.default_rng(0).normal(size=(3, 2, 80))
    z = iir.digital(iir.butterworth(3), (8, 30), "bandpass", 100.0)
    b, a = iir.transfer(z)
    y = iir.lfilter(b, a, x)
    np.testing.assert_allclose(y[2, 1], direct(b, a, x[2, 1]), atol=1e-10)
    np.testing.assert_allclose(iir.sosfilt(iir.sections(z), x), y, atol=1e-9)
    taps = np.array([0.2, 0.5, -0.1])
    np.testing.assert_allclose(iir.lfilter(taps, np.ones(1), x)[0, 0], np.convolve(x[0, 0], taps)[:80], atol=1e-12)


def test_forward_backward():
    x = np.random.default_rng(1).normal(size=(2, 200))
    z = iir.digital(iir.butterworth(2), 10, "lowpass", 100.0)
    b, a = iir.transfer(z)
    np.testing.assert_allclose(iir.filtfilt(b, a, np.ones((1, 50))), 1, atol=1e-10)
    np.testing.assert_allclose(iir.filtfilt(b, a, x)[:, 60:140], iir.sosfiltfilt(iir.sections(z), x)[:, 60:140], atol=1e-4)
    np.testing.assert_allclose(iir.sosfiltfilt(iir.sections(z), np.full((1, 60), 3.0)), 3.0, atol=1e-10)
    t = np.arange(400) / 100
    wave = np.sin(2 * np.pi * 2 * t)
    assert np.abs(iir.filtfilt(b, a, wave[None])[0] - wave * abs(gain(z, 2, 100.0)[0]) ** 2)[50:-50].max() < 1e-3
    with pytest.raises(ValueError):
        iir.filtfilt(b, a, np.ones((1, 5)))


def test_steady_state_holds_a_step():
    b, a = iir.transfer(iir.digital(iir.chebyshev1(4, 1.0), 20, "lowpass", 100.0))
    y = iir.lfilter(b, a, np.ones((1, 30)), iir.steady_state(b, a)[None])
    np.testing.assert_allclose(y, b.sum() / a.sum(), atol=1e-9)


@pytest.mark.parametrize("low,high,inside,outside", [(None, 20, 5, 40), (20, None, 40, 5), (10, 30, 20, 45), (30, 10, 2, 20)])
def test_fir_bands(low, high, inside, outside):
    h = fir.design(100.0, low, high)
    g = lambda f, h=h: abs(iir.response(h, np.ones(1), np.array([f]), 100.0)[0])
    assert g(inside) == pytest.approx(1, abs=0.01) and g(outside) < 0.01
    np.testing.assert_allclose(h, h[::-1], atol=1e-12)


def test_minimum_phase_keeps_the_magnitude():
    h = fir.design(128.0, 1, 40)
    m = fir.minimum_phase(h)
    f = np.linspace(3, 35, 50)
    np.testing.assert_allclose(np.abs(iir.response(m, np.ones(1), f, 128.0)), np.abs(iir.response(h, np.ones(1), f, 128.0)), atol=0.02)
    energy = np.cumsum(m**2) / (m**2).sum()
    assert energy[len(m) // 4] > 0.9  # early, not centred


@pytest.mark.parametrize("factor", [0.5, 0.75, 1, 2, 2.5])
def test_resample_reproduces_a_sinusoid(factor):
    n, m = 40, math.ceil(40 * factor)
    wave = lambda k: np.sin(2 * np.pi * 3 * np.arange(k) / k + 0.3)
    np.testing.assert_allclose(fir.resample(wave(n)[None], factor, 1)[0], wave(m), atol=1e-12)


def test_distribution_functions():
    x = np.linspace(0.01, 120, 300)
    half = x / 2
    closed = 1 - np.exp(-half) * (1 + half + half**2 / 2)
    np.testing.assert_allclose(special.chi2_cdf(x, 6), closed, atol=1e-13)
    assert special.chi2_cdf(np.array([-1.0, 0.0, np.inf]), 55).tolist() == [0, 0, 1]
    assert np.isnan(special.chi2_cdf(np.array([np.nan]), 3)[0])
    assert special.normal_cdf(np.array([1.959963984540054]))[0] == pytest.approx(0.975, abs=1e-12)


def random_spd(rng, m, n):
    x = rng.normal(size=(m, n, 3 * n))
    return x @ x.transpose(0, 2, 1) / (3 * n) + 0.05 * np.eye(n)


@given(st.integers(0, 10_000))
@settings(max_examples=20, deadline=None)
def test_distance_is_affine_invariant(seed):
    rng = np.random.default_rng(seed)
    a, b = random_spd(rng, 2, 4)
    w = rng.normal(size=(4, 4)) + 3 * np.eye(4)
    d = spd.distance(a, b)
    assert d == pytest.approx(spd.distance(b, a), rel=1e-8)
    assert d == pytest.approx(spd.distance(w @ a @ w.T, w @ b @ w.T), rel=1e-6)
    assert d == pytest.approx(spd.distance(np.linalg.inv(a), np.linalg.inv(b)), rel=1e-6)
    assert np.linalg.norm(spd.tangent(b, a)) == pytest.approx(d, rel=1e-8)
    np.testing.assert_allclose(spd.from_tangent(spd.tangent(b, a), a), b, atol=1e-9)
    assert spd.distance(a, spd.geodesic(a, b, 0.3)) == pytest.approx(0.3 * d, rel=1e-7)


def test_mean():
    rng = np.random.default_rng(4)
    c = random_spd(rng, 12, 5)
    m = spd.mean(c)
    w = spd.invsqrtm(m)
    assert np.linalg.norm(spd.logm(w @ c @ w).mean(0)) < 1e-7
    d = np.stack([np.diag(v) for v in rng.uniform(0.5, 3, (6, 3))])
    np.testing.assert_allclose(spd.mean(d), spd.expm(spd.logm(d).mean(0)), atol=1e-8)
    assert spd.distance(np.array([[2.0]]), np.array([[3.0]])) == pytest.approx(math.log(1.5))
    with pytest.raises(np.linalg.LinAlgError):
        spd.logm(-np.eye(2))


def test_covariance_regularisation():
    x = np.random.default_rng(0).normal(size=(2, 3, 30))
    np.testing.assert_allclose(spd.covariance(x)[1], np.cov(x[1]), atol=1e-12)
    np.testing.assert_allclose(spd.covariance(x, 0.1)[1], (np.cov(x[1]) + 0.1 * np.eye(3)) / 1.1, atol=1e-12)


def blobs(rng, k, n, p, far=4.0):
    centers = rng.normal(size=(k, p)) * far
    y = np.repeat(np.arange(k), n)
    return centers[y] + rng.normal(size=(k * n, p)), y


@pytest.mark.parametrize("make", [lambda: learn.Lda("lsqr"), lambda: learn.Lda("lsqr", "auto"), lambda: learn.Lda("lsqr", 0.3), learn.Svm, lambda: learn.Svm(kernel="linear"), lambda: learn.Svm(kernel="poly"), learn.Logistic])
def test_classifiers_separate_blobs(make):
    x, y = blobs(np.random.default_rng(2), 3, 60, 5)
    model = make().fit(x[::2], y[::2])
    assert (model.predict(x[1::2]) == y[1::2]).mean() > 0.95
    if hasattr(model, "predict_proba"):
        p = model.predict_proba(x)
        np.testing.assert_allclose(p.sum(1), 1)


def test_lda_doesnt_mind_affine_maps():
    rng = np.random.default_rng(3)
    x, y = blobs(rng, 3, 50, 4, 1.0)
    w = rng.normal(size=(4, 4)) + 2 * np.eye(4)
    assert np.array_equal(learn.Lda("lsqr").fit(x, y).predict(x), learn.Lda("lsqr").fit(x @ w, y).predict(x @ w))


def test_logistic_gradient_is_zero():
    x, y = blobs(np.random.default_rng(5), 2, 40, 3, 0.7)
    m = learn.Logistic(C=0.5).fit(x, y)
    p = m.predict_proba(x) - np.eye(2)[y]
    np.testing.assert_allclose(p.T @ x + m.w[:, :-1] / 0.5, 0, atol=1e-6)


def test_svm_meets_its_conditions():
    x, y = blobs(np.random.default_rng(6), 2, 40, 2, 0.8)
    m = learn.Svm(C=2.0, tol=1e-6).fit(x, y)
    _, _, support, weight, bias = m.machines[0]
    assert abs(weight.sum()) < 1e-9 and np.all(np.abs(weight) <= 2.0 + 1e-9)
    margin = np.where(y == 0, 1, -1) * (m.gram(x, support) @ weight + bias)
    held = {tuple(s): abs(w) for s, w in zip(support, weight)}
    for row, g in zip(x, margin):
        a = held.get(tuple(row), 0.0)
        assert g >= 1 - 1e-4 if a == 0 else g <= 1 + 1e-4


def test_csp_diagonalises_both_classes():
    a, b = random_spd(np.random.default_rng(7), 2, 5)
    w = learn.csp_filters([a, b], 5)
    for c in (w @ a @ w.T, w @ b @ w.T):
        np.testing.assert_allclose(c - np.diag(np.diag(c)), 0, atol=1e-9)
    assert learn.csp_filters([a, b, a + b], 4).shape == (4, 5)


def test_anova_f():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(30, 3)), np.repeat([0, 1, 2], 10)
    groups = [x[y == k] for k in range(3)]
    f = learn.anova_f(np.array([10.0] * 3), np.stack([g.sum(0) for g in groups]), np.stack([(g**2).sum(0) for g in groups]))
    between = sum(10 * (g.mean(0) - x.mean(0)) ** 2 for g in groups) / 2
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / 27
    np.testing.assert_allclose(f, between / within)


def test_prediction_strength_finds_two_blobs():
    x, _ = blobs(np.random.default_rng(9), 2, 60, 2, 8.0)
    assert learn.prediction_strength(x, 2)[0] > 0.9
    assert learn.prediction_strength(x, 5)[0] < 0.8


def test_ledoit_wolf_limits():
    rng = np.random.default_rng(10)
    s = learn.ledoit_wolf(rng.normal(size=(10, 40)))
    assert np.all(np.linalg.eigvalsh(s) > 0)
    big = rng.normal(size=(20_000, 3)) * [1, 2, 3]
    np.testing.assert_allclose(learn.ledoit_wolf(big), np.cov(big.T, bias=True), atol=0.05)
