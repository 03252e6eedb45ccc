"""Cross-validation in step: equal to fitting each fold alone, with one pass for all folds where moments determine a fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import base, classify, elementwise, features, reduce
from kymo.operators.base import Trials
from kymo.plans.pipeline import Plan

from .test_moments import trials_of


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(0)
    y = np.arange(90) % 3
    x = rng.normal(size=(90, 4, 12))
    for c in range(3):
        x[y == c, c] *= 2.5
    return trials_of(spark, x, y)


def alone(build, trials, predicted, statistic, folds, **options):
    """A fit for each fold, one after the other."""
    marked = classify.stratified_folds(trials.df, "label", "trial_id", folds)
    out = []
    for k in range(folds):
        fitted = build().fit(trials.with_df(marked.filter(F.col("fold") != k)))
        tested = fitted.transform(trials.with_df(marked.filter(F.col("fold") == k))).df
        out.append(classify.metric(tested, "label", predicted, statistic, **options))
    return out


PLANS = {
    "lda": lambda: Plan([reduce.Var("x", "f", axis=1), classify.Classifier("f", "p", classify.lda("lsqr"))]),
    "selection then lda": lambda: Plan([reduce.Var("x", "f", axis=1), features.FeatureSelection("f", "g", 3), classify.Classifier("g", "p", classify.lda("lsqr", 0.1))]),
    "csp, logarithms, normalised, lda": lambda: Plan([features.Csp("x", "c", 3), reduce.Var("c", "v", axis=1), elementwise.Log("v", "l"), features.FeatureNormalization("l", "n"), classify.Classifier("n", "p", classify.lda("lsqr"))]),
    "logistic behind a normalisation": lambda: Plan([reduce.Var("x", "f", axis=1), features.FeatureNormalization("f", "n"), classify.Classifier("n", "p", classify.logistic_regression())]),
    "svm": lambda: Plan([reduce.Var("x", "f", axis=1), classify.Classifier("f", "p", classify.svm())]),
}


@pytest.mark.parametrize("name", PLANS)
def test_equal_to_single_fits(data, name):
    cv = classify.CrossValidation(PLANS[name], "p", folds=3, average="macro")
    mean = cv.run(data)
    want = alone(PLANS[name], data, "p", "accuracy", 3)
    np.testing.assert_allclose(cv.scores, want)
    assert mean == pytest.approx(np.mean(want)) and mean > 0.5


def test_macro_and_entropy(data):
    build = lambda: Plan([reduce.Var("x", "f", axis=1), classify.Classifier("f", "p", classify.lda("lsqr"), "q")])
    for statistic, options in (("f1", {"average": "macro"}), ("cross_entropy", {"proba": "q"})):
        cv = classify.CrossValidation(build, "p", folds=4, statistic=statistic, **options)
        cv.run(data)
        np.testing.assert_allclose(cv.scores, alone(build, data, "p", statistic, 4, **options))


def test_one_pass_for_all_folds(data, monkeypatch):
    """The number of passes for moments doesn't depend on the number of folds."""
    calls = []
    real = base.moments_by
    for module in (features, classify):
        monkeypatch.setattr(module, "moments_by", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    for folds in (2, 5):
        calls.clear()
        classify.CrossValidation(PLANS["csp, logarithms, normalised, lda"], "p", folds=folds).run(data)
        assert len(calls) == 3  # one for each estimator


def test_folds_of_large_classes(spark):
    """Folds by places over all tasks: as one numbering of each class gives them."""
    df = spark.range(3000).select(F.col("id").alias("trial_id"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").alias("label"))
    got = classify.stratified_folds(df.repartition(6), "label", "trial_id", 4).collect()
    for label in ("big", "small", None):
        own = sorted((r["trial_id"], r["fold"]) for r in got if r["label"] == label)
        assert [f for _, f in own] == [i % 4 for i in range(len(own))]
    seeded = classify.stratified_folds(df, "label", "trial_id", 4, shuffle_seed=3)
    sizes = {r["label"]: [] for r in seeded.select("label").distinct().collect()}
    for r in seeded.groupBy("label", "fold").count().collect():
        sizes[r["label"]].append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 4 for v in sizes.values())
    assert isinstance(Trials(df, {}), Trials)
