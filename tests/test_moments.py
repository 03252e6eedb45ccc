"""Moments that merge: data far from zero give what the same data about zero give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.numerics import learn
from kymo.operators import base, classify, features
from kymo.operators.base import Moments, Trials, merge_all, moments_by


def trials_of(spark, x, y, partitions=5):
    rows = [(i, float(c), np.ravel(v).tolist()) for i, (v, c) in enumerate(zip(x, y))]
    return Trials(spark.createDataFrame(rows, "trial_id long, label double, x array<double>").repartition(partitions), {"x": x.shape[1:]})


def test_parts_merge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 4)) + 1e8
    parts = [Moments.of(p, True) for p in np.array_split(x, [1, 10, 500])]
    m = merge_all(parts)
    assert m.count == 1000
    np.testing.assert_allclose(m.covariance, np.cov((x - 1e8).T, bias=True), rtol=1e-6)
    y = rng.integers(0, 3, 1000)
    found = moments_by(trials_of(spark, x, y), "x", [F.col("label"), F.col("trial_id") % 2], False)
    assert list(found) == [(float(a), float(b)) for a in range(3) for b in range(2)]
    for (a, b), m in found.items():
        own = x[(y == a) & (np.arange(1000) % 2 == b)]
        np.testing.assert_allclose(m.centred / m.count, (own - 1e8).var(axis=0), rtol=1e-6)


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_selection_far_from_zero(spark, offset):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 12)) * 2
    x[:, [2, 7, 11]] += y[:, None] * np.array([1.0, 2.0, 0.8])
    chosen = features.FeatureSelection("x", "y", 3).fit(trials_of(spark, x + offset, y)).index
    assert chosen.tolist() == [2, 7, 11]


@pytest.mark.parametrize("offset", [1e6, 1e8])
def test_filters_and_discriminants_far_from_zero(spark, offset):
    rng = np.random.default_rng(2)
    y = np.arange(120) % 2
    x = rng.normal(size=(120, 4, 30))
    x[y == 1, 0] *= 3
    x[y == 1] += 0.3
    near, far = trials_of(spark, x, y), trials_of(spark, x + offset, y)
    for make in (lambda: features.Csp("x", "o", 2), lambda: features.Csp("x", "o", 2, cov_est="epoch")):
        np.testing.assert_allclose(make().fit(far).filters, make().fit(near).filters, rtol=1e-4, atol=1e-5)
    a, b = (features.XDawnCovariance("x", "o", 2).fit(t) for t in (near, far))
    signal = lambda f: np.abs(np.sign(f.filters[0]))
    assert a.filters.shape == b.filters.shape == (4, 4) and signal(a).shape == (4,)
    flat = x[:, :, :2].reshape(120, 8)
    want = learn.Lda("lsqr").fit(flat, y.astype(float))
    got = classify.Classifier("x", "o", classify.lda("lsqr")).fit(trials_of(spark, flat + offset, y)).predict.lda
    np.testing.assert_allclose(got.coef[1] - got.coef[0], want.coef[1] - want.coef[0], rtol=1e-4, atol=1e-5)


def test_xdawn_data_covariance_far_from_zero(spark):
    """The whole power is centred: a common offset of evoked responses is part of the signal, but not of the noise."""
    rng = np.random.default_rng(3)
    y = np.arange(60) % 2
    x = rng.normal(size=(60, 3, 20))
    found = features.XDawnCovariance("x", "o", 2).moments(trials_of(spark, x + 1e8, y))
    data = merge_all(m for k, m in found.items() if k[-1] != "then").covariance
    np.testing.assert_allclose(data, np.cov(x.transpose(1, 0, 2).reshape(3, -1), bias=True), rtol=1e-6, atol=1e-7)
    for c in (0.0, 1.0):
        np.testing.assert_allclose(found[(c, "then")].mean - 1e8, x[y == c].mean(axis=0).ravel(), atol=1e-6)


def test_many_features_in_bounded_memory(spark):
    """A thousand features: blocks are multiplied, no product of a single trial is made."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 200))
    m = Moments.of(x, True)
    assert m.centred.nbytes == 200 * 200 * 8
    y = (x[:, 0] > 0).astype(float)
    df = spark.range(3000).select(F.col("id").alias("trial_id"), (F.col("id") % 2).cast("double").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.rand(1) + i * (F.col("id") % 2) / 1000).alias("x"))
    fitted = classify.Classifier("x", "o", classify.lda("lsqr", 0.1)).fit(Trials(df, {"x": (1000,)}))
    assert fitted.predict.lda.coef.shape == (2, 1000) and y.sum() > 0 and base.SUMMED * 1000 * 1000 * 8 > 4e9
