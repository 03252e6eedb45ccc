"""Support vector machines over partitions, probabilities, and sparse logistic regression."""

import pickle

import numpy as np
import pytest

from kymo.numerics import learn
from kymo.operators import cascade, classify
from kymo.operators.base import Trials


def data(n, classes=2, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, 3)) * noise + np.stack([np.cos(2 * y), np.sin(2 * y), y * 0.3], axis=1) * 1.5
    return x, y.astype(float)


def trials_of(spark, x, y, partitions=5):
    rows = [(i, None if c != c else float(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))]
    return Trials(spark.createDataFrame(rows, "trial_id long, label double, f array<double>").repartition(partitions), {"f": (x.shape[1],)})


def conditions(svm, x, y):
    """How far each machine is from the conditions of the optimum on all rows."""
    worst = 0.0
    for n, (i, j, support, weight, bias) in enumerate(svm.machines):
        pick = (y == svm.classes[i]) | (y == svm.classes[j])
        sign = np.where(y[pick] == svm.classes[i], 1.0, -1.0)
        margin = sign * svm.margins(x[pick], n)
        known = {tuple(np.round(s, 12)): abs(w) for s, w in zip(support, weight)}
        alpha = np.array([known.get(tuple(np.round(v, 12)), 0.0) for v in x[pick]])
        most = np.where(sign > 0, svm.most[i], svm.most[j])
        assert abs(weight.sum()) < 1e-9 and (alpha <= most + 1e-9).all()
        worst = max(worst, np.max((1 - margin)[alpha < 1e-9], initial=0), np.max((margin - 1)[alpha > most - 1e-9], initial=0), np.max(np.abs(margin - 1)[(alpha > 1e-9) & (alpha < most - 1e-9)], initial=0))
    return worst


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(classify, "MOST_DOUBLES", 20_000)
    monkeypatch.setattr(cascade, "BLOCK", 64)
    monkeypatch.setattr(cascade, "WORST", 20)


@pytest.mark.parametrize("classes, options", [(2, {}), (2, {"kernel": "linear", "C": 0.3}), (3, {"kernel": "poly", "coef0": 1.0}), (4, {"class_weight": "balanced"})])
def test_equal_to_one_machine(spark, blocks, classes, options):
    x, y = data(700, classes, classes)
    fitted = classify.svm(tol=1e-5, **options)
    trials = trials_of(spark, x, y)
    out = classify.Classifier("f", "o", fitted).fit(trials).apply(trials).df.select("trial_id", "o").collect()
    want = learn.Svm(tol=1e-5, **options).fit(x, y)
    assert fitted.width == pytest.approx(want.width) and len(fitted.machines) == classes * (classes - 1) // 2
    assert conditions(fitted, x, y) < 1e-3
    for a, b in zip(fitted.machines, want.machines):
        assert len(a[3]) == pytest.approx(len(b[3]), abs=3)
    for n in range(len(want.machines)):
        np.testing.assert_allclose(fitted.margins(x, n), want.margins(x, n), atol=5e-3)
    assert np.mean([r["o"] == c for r, c in zip(sorted(out, key=lambda r: r["trial_id"]), want.predict(x))]) > 0.995


def test_partitions_of_one_class_and_missing_labels(spark, blocks):
    """Rows sorted by class, so that blocks know only one; rows without label or features take no part."""
    x, y = data(600, 2, 5, 0.7)
    order = np.argsort(y)
    x, y = x[order], y[order]
    marked = y.copy()
    marked[::50] = np.nan
    rows = [(i, None if c != c else float(c), None if i % 77 == 0 else v.tolist()) for i, (v, c) in enumerate(zip(x, marked))]
    df = spark.createDataFrame(rows, "trial_id long, label double, f array<double>").coalesce(3)
    fitted = classify.svm(tol=1e-5)
    classify.Classifier("f", "o", fitted).fit(Trials(df, {"f": (3,)}))
    used = (marked == marked) & (np.arange(600) % 77 != 0)
    assert conditions(fitted, x[used], y[used]) < 1e-3


def test_a_model_beyond_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(classify, "MOST_DOUBLES", 300)
    monkeypatch.setattr(cascade, "BLOCK", 64)
    x, y = data(500, 2, 6, 5.0)
    with pytest.raises(MemoryError, match="support vectors"):
        classify.Classifier("f", "o", classify.svm()).fit(trials_of(spark, x, y))


def test_classes_that_overlap_are_fitted_on_all(spark, monkeypatch):
    """Nearly every trial is support in four pairs, which together pass the bound; the trials themselves don't."""
    monkeypatch.setattr(classify, "MOST_DOUBLES", 6000)
    monkeypatch.setattr(cascade, "BLOCK", 64)
    monkeypatch.setattr(cascade, "WORKING", 40)
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(600, 3)), rng.integers(0, 5, 600).astype(float)
    fitted = classify.svm(probability=True, tol=1e-4)
    trials = trials_of(spark, x, y)
    out = classify.Classifier("f", "o", fitted, "p").fit(trials).apply(trials).df.orderBy("trial_id").collect()
    want = learn.Svm(probability=True, tol=1e-4).fit(x, y)
    assert sum(len(m[3]) for m in fitted.machines) * 3 > 6000
    assert conditions(fitted, x, y) < 1e-3
    np.testing.assert_allclose(fitted.all_margins(x), want.all_margins(x), atol=5e-3)
    np.testing.assert_allclose([r["p"] for r in out], want.predict_proba(x), atol=5e-3)
    assert np.mean([r["o"] for r in out] == want.predict(x)) > 0.99


def test_a_large_model_is_not_held(spark, monkeypatch):
    """What a task gets of a model doesn't grow with the support, and scores are those of its vectors."""
    monkeypatch.setattr(classify, "MOST_DOUBLES", 12_000)
    monkeypatch.setattr(cascade, "BLOCK", 64)
    monkeypatch.setattr(cascade, "WORKING", 64)
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(300, 8)), rng.integers(0, 3, 300).astype(float)
    fitted, trials = classify.svm(tol=1e-4), trials_of(spark, x, y)
    out = classify.Classifier("f", "o", fitted).fit(trials).apply(trials).df.orderBy("trial_id").collect()
    assert len(pickle.dumps(fitted)) < 8 * 12_000 / cascade.SHARE
    held = [fitted.gram(x, v) @ w + b for _, _, v, w, b in fitted.machines]
    np.testing.assert_allclose(fitted.all_margins(x), np.stack(held, axis=1), atol=1e-9)
    monkeypatch.setattr(learn, "TILE", 37)
    np.testing.assert_allclose(fitted.all_margins(x), np.stack(held, axis=1), atol=1e-9)
    assert [r["o"] for r in out] == fitted.predict(x).tolist()
    np.testing.assert_allclose(fitted.all_margins(x), learn.Svm(tol=1e-4).fit(x, y).all_margins(x), atol=5e-3)


def test_more_trials_may_take_more_rounds(spark, monkeypatch):
    """Small working sets take more rounds; what they may take follows the trials."""
    monkeypatch.setattr(classify, "MOST_DOUBLES", 6000)
    monkeypatch.setattr(cascade, "BLOCK", 64)
    monkeypatch.setattr(cascade, "WORKING", 24)
    monkeypatch.setattr(cascade, "ROUNDS", 2)
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300).astype(float)
    fitted = classify.svm(tol=1e-4)
    classify.Classifier("f", "o", fitted).fit(trials_of(spark, x, y))
    assert conditions(fitted, x, y) < 1e-3


@pytest.mark.parametrize("classes", [2, 3])
def test_probabilities(spark, blocks, classes):
    x, y = data(600, classes, 7)
    fitted = classify.svm(probability=True, tol=1e-4)
    trials = trials_of(spark, x, y)
    out = classify.Classifier("f", "o", fitted, "p").fit(trials).apply(trials).df.orderBy("trial_id").collect()
    p = np.array([r["p"] for r in out])
    want = learn.Svm(probability=True, tol=1e-4).fit(x, y).predict_proba(x)
    np.testing.assert_allclose(p, want, atol=5e-3)
    np.testing.assert_allclose(p.sum(axis=1), 1)
    for c in range(classes):  # calibrated: as many rows as their probabilities say
        assert abs(p[:, c].mean() - (y == c).mean()) < 0.02
    assert -np.log(p[np.arange(600), y.astype(int)]).mean() < -np.log([(y == c).mean() for c in range(classes)]).mean() * 0.8
    with pytest.raises(TypeError):
        classify.Classifier("f", "o", classify.svm(), "p")


def test_coupling():
    """Pairs that agree with some probabilities give these."""
    p = np.random.default_rng(8).dirichlet(np.ones(5), 20)
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    np.testing.assert_allclose(learn.coupled(r * (1 - np.eye(5))), p, atol=1e-9)


# ---- sparse logistic regression ----


def objective(m, x, y, w):
    at = np.searchsorted(m.classes, y)
    s = x @ w[:, :-1].T + w[:, -1]
    loss = (np.logaddexp.reduce(s, axis=1) - s[np.arange(len(x)), at]).sum()
    c = w[:, :-1]
    ratio = {"l1": 1.0, "l2": 0.0}.get(m.penalty, m.l1_ratio)
    return loss + (ratio * np.abs(c).sum() + (1 - ratio) / 2 * (c**2).sum()) / m.C


@pytest.mark.parametrize("options", [{"penalty": "l1", "C": 0.1}, {"penalty": "l1", "C": 10.0}, {"penalty": "elasticnet", "l1_ratio": 0.5, "C": 0.2}, {"penalty": "elasticnet", "l1_ratio": 0.0, "C": 1.0}])
def test_sparse_logistic_meets_its_conditions(spark, options):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 12))
    y = (np.stack([x[:, 0], x[:, 1] - x[:, 0], -x[:, 1]], axis=1) + rng.gumbel(size=(500, 3))).argmax(axis=1).astype(float)
    m = classify.logistic_regression(**options)
    classify.Classifier("f", "o", m).fit(trials_of(spark, x, y))
    at, c = y.astype(int), m.w[:, :-1]
    s = x @ c.T + m.w[:, -1]
    q = np.exp(s - s.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    gradient = (q - np.eye(3)[at]).T @ np.hstack([x, np.ones((500, 1))])
    ratio = 1.0 if m.penalty == "l1" else m.l1_ratio
    smooth, lam = gradient[:, :-1] + (1 - ratio) / m.C * c, ratio / m.C
    assert np.abs(gradient[:, -1]).max() < 1e-5
    assert np.abs(smooth + lam * np.sign(c))[c != 0].max() < 1e-5
    assert (np.abs(smooth)[c == 0] <= lam + 1e-5).all()
    if options["C"] == 0.1:
        assert (c == 0).sum() > 15 and set(np.flatnonzero(np.abs(c).max(axis=0))) >= {0, 1}
    if ratio == 0:
        np.testing.assert_allclose(c, learn.Logistic(C=m.C).fit(x, y).w[:, :-1], atol=1e-5)
    for _ in range(30):  # no other point near or far is better
        assert objective(m, x, y, m.w) <= objective(m, x, y, m.w + rng.normal(size=m.w.shape) * 10 ** rng.uniform(-4, 0)) + 1e-7


def test_strong_penalties_leave_the_intercept(spark):
    x, y = data(200, 2, 10)
    m = classify.logistic_regression(C=1e-4, penalty="l1")
    m.fit(x, y)
    assert (m.w[:, :-1] == 0).all() and m.predict_proba(x)[0, 1] == pytest.approx(y.mean(), abs=1e-6)
    for bad in ({"penalty": "l3"}, {"penalty": "elasticnet"}, {"penalty": "l1", "l1_ratio": 0.5}, {"penalty": "elasticnet", "l1_ratio": 2.0}):
        with pytest.raises(ValueError):
            classify.logistic_regression(**bad)
