"""Options of designs and learners."""

import numpy as np
import pytest

from kymo.numerics import fir, iir, learn, spd
from kymo.operators import classify, riemann, signal
from kymo.operators.base import Trials


def response(h, f, fs):
    return np.abs(np.exp(-2j * np.pi * np.outer(f, np.arange(len(h))) / fs) @ h)


@pytest.mark.parametrize("low,high,passes,stops", [(None, 20.0, [1, 10, 19], [30, 45]), (20.0, None, [22, 40], [1, 10]), (10.0, 30.0, [12, 20, 28], [2, 45]), (30.0, 10.0, [2, 45], [16, 20, 24])])
def test_frequency_sampling(low, high, passes, stops):
    for phase in ("zero", "minimum"):
        h = fir.design(100.0, low, high, 101, 5.0, 5.0, phase, method="firwin2")
        assert np.allclose(response(h, np.array(passes), 100.0), 1, atol=0.08) and (response(h, np.array(stops), 100.0) < 0.08).all()
    both = [fir.design(100.0, low, high, 101, 5.0, 5.0, method=m) for m in ("firwin", "firwin2")]
    assert np.abs(both[0] - both[1]).max() < 0.05


def test_recursive_designs_for_a_band():
    made = signal.FilterDesign.fir(100.0, 10.0, 30.0, method="iir", iir_params={"order": 3, "kind": "cheby1", "ripple_db": 1.0})
    want = signal.FilterDesign.cheby1(3, 1.0, (10.0, 30.0), "bandpass", "sos", 100.0)
    assert made.kind == "sos" and np.array_equal(made.coefficients, want.coefficients)
    stop = signal.FilterDesign.fir(100.0, 30.0, 10.0, method="iir", iir_params={"output": "ba"})
    b, a = iir.transfer(iir.digital(iir.butterworth(4), (10.0, 30.0), "bandstop", 100.0))
    assert np.allclose(stop.coefficients[0], b) and np.allclose(stop.coefficients[1], a)
    for bad in ({"method": "x"}, {"design": "x"}, {"method": "iir", "iir_params": {"kind": "x"}}):
        with pytest.raises(ValueError):
            signal.FilterDesign.fir(100.0, 10.0, 30.0, **bad)


def blobs(n=300, seed=1):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.15).astype(float)
    return rng.normal(size=(n, 3)) + y[:, None] * [1.0, 0.5, 0.0], y


def test_class_weights():
    x, y = blobs()
    weights = learn.class_weights("balanced", np.array([0.0, 1.0]), np.array([255, 45]))
    assert np.allclose(weights * [255, 45], 150)
    # a weight of two is each trial twice
    twice = np.concatenate([x, x[y == 1]]), np.concatenate([y, y[y == 1]])
    for make in (lambda **o: learn.Logistic(0.7, **o), lambda **o: learn.Svm(0.7, "linear", tol=1e-9, **o)):
        weighted, repeated = make(class_weight={1: 2.0}).fit(x, y), make().fit(*twice)
        if isinstance(weighted, learn.Logistic):
            np.testing.assert_allclose(weighted.w[1] - weighted.w[0], repeated.w[1] - repeated.w[0], atol=1e-6)  # both may move together
        assert np.array_equal(weighted.predict(x), repeated.predict(x))
    assert learn.Svm(class_weight="balanced").fit(x, y).predict(x).sum() > learn.Svm().fit(x, y).predict(x).sum()
    with pytest.raises(ValueError):
        learn.Logistic(class_weight="x").fit(x, y)


def test_penalty_and_intercept():
    x, y = blobs()
    free = learn.Logistic(1.0, penalty=None).fit(x, y)
    s = np.hstack([x, np.ones((len(x), 1))]) @ (free.w[1] - free.w[0])
    assert np.abs((1 / (1 + np.exp(-s)) - y) @ np.hstack([x, np.ones((len(x), 1))])).max() < 1e-5
    assert np.abs(learn.Logistic(fit_intercept=False).fit(x, y).w[:, -1]).max() < 1e-9
    with pytest.raises(ValueError):
        learn.Logistic(penalty="l0")


def test_singular_directions_of_lda():
    x, y = blobs()
    flat = np.hstack([x, x[:, :1] + x[:, 1:2]])  # one column too many
    for tol in (None, 1e-4):
        assert np.array_equal(learn.Lda("svd", tol=tol).fit(flat, y).predict(flat), learn.Lda("svd").fit(x, y).predict(x))


def test_weighted_and_following_tangent_spaces(spark):
    c = spd.covariance(np.random.default_rng(3).normal(size=(12, 3, 20)))
    w = np.arange(12.0)
    df = spark.createDataFrame([(i, x.ravel().tolist(), float(k)) for i, (x, k) in enumerate(zip(c, w))], "trial_id long, c array<double>, w double")
    trials = Trials(df, {"c": (3, 3)}, label=None)
    for metric, mean in (("riemann", spd.mean(c, w)), ("euclid", np.average(c, axis=0, weights=w)), ("logeuclid", spd.expm(np.average(spd.logm(c), axis=0, weights=w)))):
        np.testing.assert_allclose(riemann.TangentSpace("c", "t", metric=metric, weights="w").reference(trials), mean, atol=1e-7)
    following = riemann.TangentSpace("c", "t", tsupdate=True).fit(trials)
    some = trials.with_df(df.filter("trial_id < 5"))
    got = np.array([r["t"] for r in following.apply(some).df.orderBy("trial_id").collect()])
    np.testing.assert_allclose(got, spd.tangent(c[:5], spd.mean(c[:5])), atol=1e-6)
    with pytest.raises(ValueError):
        riemann.TangentSpace("c", "t", metric="x")


def test_options_reach_learners():
    assert classify.svm(class_weight="balanced").class_weight == "balanced" and classify.lda(tol=1e-3).tol == 1e-3
    assert classify.logistic_regression(penalty=None, fit_intercept=False).fit_intercept is False
