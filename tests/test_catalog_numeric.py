"""Catalog queries that SQL doesn't express, against numpy over the whole table at once."""

import itertools
from pathlib import Path

import duckdb
import numpy as np
import pytest

from kymo.numerics import learn
from kymo.plans import catalog

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the synthetic tables aren't here")
NAMES = ("csp xdawn_covariance riemann_mdm riemann_potato tangent_space adaptive_rebias classifier_lda classifier_lda_shrinkage classifier_svm classifier_svm_probability "
         "classifier_logistic pattern_state multi_potato cross_validate").split()


@pytest.fixture(scope="module")
def data():
    rows = duckdb.sql(f"select vec_id, label, embedding from '{TABLES}/embeddings.parquet' order by vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float).reshape(len(rows), 4, 16)


def got(spark, name, shape=()):
    rows = catalog.queries()[name](spark, str(TABLES)).collect()
    key = lambda r: (r["trial_id"], r["pos"]) if shape else r["trial_id"]
    values = np.array([r["v"] for r in sorted(rows, key=key)])
    return values.reshape(-1, *shape)


def test_these_are_the_queries_without_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(NAMES)


# ---- by definition ----


def function(m, f):
    w, v = np.linalg.eigh(m)
    return (v * f(w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def covariances(x, r):
    return np.stack([(np.cov(t) + r * np.eye(len(t))) / (1 + r) for t in x])


def mean(c):
    m = c.mean(axis=0)
    for _ in range(60):
        root, inverse = function(m, np.sqrt), function(m, lambda w: w**-0.5)
        m = root @ function(function(inverse @ c @ inverse, np.log).mean(axis=0), np.exp) @ root
    return m


def distance(a, c):
    inverse = function(a, lambda w: w**-0.5)
    return np.sqrt((np.log(np.linalg.eigvalsh(inverse @ c @ inverse)) ** 2).sum(axis=-1))


def nearest(c, y, train):
    classes = np.unique(y[train])
    means = [mean(c[train & (y == k)]) for k in classes]
    return classes[np.stack([distance(m, c) for m in means]).argmin(axis=0)]


def test_riemann_mdm(spark, data):
    _, y, x = data
    assert np.array_equal(got(spark, "riemann_mdm"), nearest(covariances(x, 0.01), y, np.ones(len(y), bool)))


def test_cross_validate(spark, data):
    ids, y, x = data
    c, fold = covariances(x, 0.01), np.empty(len(y), int)
    for k in np.unique(y):
        fold[y == k] = np.arange((y == k).sum()) % 3
    want = [(nearest(c, y, fold != k) == y)[fold == k].mean() for k in range(3)]
    rows = catalog.queries()["cross_validate"](spark, str(TABLES)).orderBy("fold").collect()
    np.testing.assert_allclose([r["accuracy"] for r in rows], want)


def test_tangent_space(spark, data):
    c = 0.99 * covariances(data[2], 0.01) + 0.01 * np.eye(4)
    inverse = function(mean(c), lambda w: w**-0.5)
    logs = function(inverse @ c @ inverse, np.log)
    want = np.stack([logs[:, i, j] * (1 if i == j else np.sqrt(2)) for i, j in itertools.combinations_with_replacement(range(4), 2)], axis=1)
    np.testing.assert_allclose(got(spark, "tangent_space", (10,)), want, atol=2e-6)


def test_riemann_potato(spark, data):
    c = 0.99 * covariances(data[2], 0.01) + 0.01 * np.eye(4)
    clean = np.ones(len(c), bool)
    while True:
        m = mean(c[clean])
        d = np.log(distance(m, c))
        mu, sigma = d[clean].mean(), d[clean].std()
        after = clean & ((d - mu) / sigma < 2.0)
        if after.sum() == clean.sum():
            break
        clean = after
    assert np.array_equal(got(spark, "riemann_potato"), ((d - mu) / sigma < 2.0).astype(float))


def test_adaptive_rebias(spark, data):
    _, y, x = data
    c = covariances(x, 0.01)
    start, want = mean(c), np.empty_like(c)
    for k in np.unique(y):
        b = start
        for i in np.flatnonzero(y == k):
            root, inverse = function(b, np.sqrt), function(b, lambda w: w**-0.5)
            want[i] = inverse @ c[i] @ inverse
            b = root @ function(want[i], lambda w: w**0.1) @ root
    np.testing.assert_allclose(got(spark, "adaptive_rebias", (4, 4)), want, atol=2e-6)


def spread(f, y):
    """Class means, pooled covariance by shares of classes, shares."""
    classes, n = np.unique(y, return_counts=True)
    means = np.stack([f[y == k].mean(axis=0) for k in classes])
    pooled = sum(m / len(y) * np.cov(f[y == k].T, bias=True) for k, m in zip(classes, n))
    return classes, means, pooled, n / len(y)


def test_classifier_lda(spark, data):
    _, y, x = data
    f = x.reshape(len(x), -1)
    classes, means, pooled, shares = spread(f, y)
    coef = (np.linalg.pinv(pooled) @ means.T).T
    scores = f @ coef.T - 0.5 * (means * coef).sum(axis=1) + np.log(shares)
    clear = np.diff(np.sort(scores, axis=1)[:, -2:], axis=1)[:, 0] > 1e-6 * np.abs(scores).max(axis=1)
    assert clear.mean() > 0.9 and np.array_equal(got(spark, "classifier_lda")[clear], classes[scores.argmax(axis=1)][clear])


def test_classifier_lda_shrinkage(spark, data):
    _, y, x = data
    f = x.reshape(len(x), -1)
    want = learn.Lda("lsqr", "auto").fit(f, y)  # on the whole table at once; the query sums moments on executors
    assert np.array_equal(got(spark, "classifier_lda_shrinkage"), want.predict(f))


def test_classifier_svm(spark, data):
    _, y, x = data
    f = x.reshape(len(x), -1)
    assert np.array_equal(got(spark, "classifier_svm"), learn.Svm().fit(f, y).predict(f))


def test_classifier_svm_probability(spark, data):
    """Of each pair: what a search finds for the sigmoid; of all pairs: the least squares that the coupling stands for."""
    _, y, x = data
    f = x.reshape(len(x), -1)
    p = got(spark, "classifier_svm_probability", (len(np.unique(y)),))
    np.testing.assert_allclose(p.sum(axis=1), 1, atol=1e-5)
    m = learn.Svm(probability=True).fit(f, y)
    np.testing.assert_allclose(p, m.predict_proba(f), atol=2e-6)
    (i, j, *_), (a, b) = m.machines[3], m.sigmoids[3]
    pick = (y == m.classes[i]) | (y == m.classes[j])
    sign = np.where(y[pick] == m.classes[i], 1.0, -1.0)
    s, targets = m.margins(f[pick], 3), learn.sigmoid_targets(int((sign > 0).sum()), int((sign < 0).sum()))
    loss = lambda u, v: learn.sigmoid_sums(s, sign, np.array([u, v]), *targets)[0]
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.1, 0, 0.1) for db in (-0.1, 0, 0.1))
    r = np.zeros((len(m.classes),) * 2)
    for (u, v, *_), (a, b), margin in zip(m.machines, m.sigmoids, (m.margins(f[:1], n)[0] for n in range(len(m.machines)))):
        r[u, v] = 1 / (1 + np.exp(a * margin + b))
        r[v, u] = 1 - r[u, v]
    spread = lambda q: ((r.T * q[:, None] - r * q[None, :]) ** 2).sum()
    rng = np.random.default_rng(0)
    for _ in range(50):
        other = np.abs(p[0] + rng.normal(size=p.shape[1]) * 0.01)
        assert spread(p[0]) <= spread(other / other.sum()) + 1e-6


def test_classifier_logistic(spark, data):
    _, y, x = data
    f = x.mean(axis=2)
    classes, at = np.unique(y, return_inverse=True)
    w, xb = np.zeros((len(classes), 5)), np.hstack([f, np.ones((len(f), 1))])
    hit, pull = np.eye(len(classes))[at], np.array([1.0, 1, 1, 1, 0])
    for _ in range(20_000):  # plain gradient descent on the convex loss
        s = xb @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.02 * ((p - hit).T @ xb + pull * w)
    s = np.sort(xb @ w.T, axis=1)
    clear = s[:, -1] - s[:, -2] > 1e-5
    assert clear.mean() > 0.9 and np.array_equal(got(spark, "classifier_logistic")[clear], classes[(xb @ w.T).argmax(axis=1)][clear])


def test_csp(spark, data):
    _, y, x = data
    k = y >= 5
    c0, c1 = (np.cov(np.concatenate(list(x[k == side]), axis=1)) for side in (False, True))
    half = function(c0 + c1, lambda w: w**-0.5)
    values, v = np.linalg.eigh(half @ c0 @ half)
    w = (half @ v)[:, np.argsort(-np.abs(values - 0.5))[:2]].T
    w *= np.sign(w[np.arange(2), np.abs(w).argmax(axis=1)])[:, None]
    np.testing.assert_allclose(got(spark, "csp", (2, 16)), w @ x, atol=2e-6)


def test_xdawn_covariance(spark, data):
    _, y, x = data
    whole = np.cov(np.concatenate(list(x), axis=1), bias=True)
    half = function(whole, lambda w: w**-0.5)
    filters, prototypes = [], []
    for k in np.unique(y):
        e = x[y == k].mean(axis=0)
        v = np.linalg.eigh(half @ (e @ e.T / 16) @ half)[1][:, ::-1][:, :2]
        w = (half @ v).T
        w *= np.sign(w[np.arange(2), np.abs(w).argmax(axis=1)])[:, None]
        filters.append(w)
        prototypes.append(w @ e)
    w, p = np.vstack(filters), np.vstack(prototypes)
    want = np.stack([np.cov(np.vstack([p, w @ t])) for t in x])
    np.testing.assert_allclose(got(spark, "xdawn_covariance", want.shape[1:]), want, atol=2e-6)


def tangents(c):
    inverse = function(mean(c), lambda w: w**-0.5)
    logs = function(inverse @ c @ inverse, np.log)
    return np.stack([logs[:, i, j] * (1 if i == j else np.sqrt(2)) for i, j in itertools.combinations_with_replacement(range(4), 2)], axis=1)


def test_pattern_state(spark, data):
    """A fixed point of k-means on scaled tangent vectors: each trial is in the cluster whose mean is nearest."""
    f = tangents(covariances(data[2], 0.01))
    f = (f - f.mean(axis=0)) / f.std(axis=0)
    state = got(spark, "pattern_state").astype(int)
    centres = np.stack([f[state == k].mean(axis=0) for k in range(3)])
    assert np.array_equal(((f[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1), state)


def test_multi_potato(spark, data):
    """Least score over clusters of a fixed point of k-means, or an outlier."""
    c = covariances(data[2], 0.01)
    f = tangents(c)
    f = (f - f.mean(axis=0)) / f.std(axis=0)
    said = got(spark, "multi_potato").astype(int)
    first = learn.kmeans(f, 2, 0)[1]
    for state in (first, 1 - first):  # clusters have no order of their own
        z = []
        for k in range(2):
            m = mean(c[state == k])
            d = np.log(distance(m, c))
            z.append((d - d[state == k].mean()) / d[state == k].std())
        z = np.stack(z, axis=1)
        if np.array_equal(np.where(z.min(axis=1) > 2.0, 2, z.argmin(axis=1)), said):
            return
    raise AssertionError("no clustering explains the result")
