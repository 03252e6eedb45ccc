"""Classifiers whose training set is larger than the driver may hold."""

import numpy as np
import pytest

from kymo.numerics import learn
from kymo.operators import classify
from kymo.operators.base import Trials


def trials(spark, n=400):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + y[:, None] * [3.0, 0.0, 2.0]
    rows = [(i, float(y[i]), x[i].tolist()) for i in range(n)]
    return Trials(spark.createDataFrame(rows, "trial_id long, label double, f array<double>"), {"f": (3,)}), x, y.astype(float)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(classify, "MOST_DOUBLES", 600)


def test_shrinkage_lda_is_fitted_from_sums(spark, small):
    data, x, y = trials(spark)
    lda = classify.lda("lsqr", "auto")
    classify.Classifier("f", "y", lda).fit(data)
    want = learn.Lda("lsqr", "auto").fit(x, y)
    np.testing.assert_allclose(lda.coef, want.coef)
    np.testing.assert_allclose(lda.intercept, want.intercept)


def test_a_learner_of_ones_own_is_fitted_on_a_sample(spark, small):
    data, x, y = trials(spark)
    sample, _ = classify.training_set(data, "f", 24)
    assert 5 < len(sample) < 60


def test_svm_is_fitted_on_all_and_scores_all(spark, monkeypatch):
    monkeypatch.setattr(classify, "MOST_DOUBLES", 6000)
    data, x, y = trials(spark)
    out = classify.Classifier("f", "y", classify.svm()).fit(data).apply(data).df.select("label", "y").collect()
    assert len(out) == 400 and np.mean([r["label"] == r["y"] for r in out]) == pytest.approx(np.mean(learn.Svm().fit(x, y).predict(x) == y), abs=0.01)
