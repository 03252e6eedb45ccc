"""Operators on small seeded tensors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.numerics import iir, spd
from kymo.operators import classify, elementwise, features, reduce, riemann, shape, signal
from kymo.operators.base import Trials
from kymo.plans.pipeline import Plan


def trials(spark, labels=None, **arrays):
    n = len(next(iter(arrays.values())))
    labels = labels if labels is not None else [None] * n
    shapes = {k: np.shape(v)[1:] for k, v in arrays.items()}
    kinds = ", ".join(f"{k} {'double' if s == () else 'array<double>'}" for k, s in shapes.items())
    rows = [(i, None if labels[i] is None else int(labels[i]), *[float(v[i]) if shapes[k] == () else [float(x) for x in np.ravel(v[i])] for k, v in arrays.items()]) for i in range(n)]
    return Trials(spark.createDataFrame(rows, f"trial_id long, label int, {kinds}"), shapes)


def values(out, name):
    got = [r[0] for r in out.df.orderBy("trial_id").select(name).collect()]
    return np.array(got, float).reshape(len(got), *out.shape(name))


def run(stage, t):
    out = (stage.fit(t) if hasattr(stage, "fit") else stage).apply(t)
    return values(out, stage.output)


X = np.random.default_rng(44).normal(size=(3, 2, 4))
ODD = np.array([[[0.0, -0.0, 1.0, -2.0], [np.nan, np.inf, -np.inf, 3.0]]])


@pytest.mark.parametrize("stage,f", [
    (elementwise.Absolute, np.abs), (elementwise.Log, np.log), (elementwise.Not, np.logical_not),
])
def test_unary(spark, stage, f):
    with np.errstate(all="ignore"):
        for x in (X, ODD):
            np.testing.assert_allclose(run(stage("x", "y"), trials(spark, x=x)), f(x).astype(float))


BINARY = [
    (elementwise.Add, np.add), (elementwise.Subtract, np.subtract), (elementwise.Multiply, np.multiply), (elementwise.Divide, np.divide), (elementwise.And, np.logical_and),
    (elementwise.Or, np.logical_or), (elementwise.Xor, np.logical_xor), (elementwise.Greater, np.greater), (elementwise.Less, np.less), (elementwise.Equal, np.equal),
]


@pytest.mark.parametrize("stage,f", BINARY)
def test_binary(spark, stage, f):
    rng = np.random.default_rng(7)
    a, b = rng.integers(-3, 3, (3, 2, 4)).astype(float), rng.integers(-3, 3, (3, 2, 4)).astype(float)
    row, one, column = b[:, 0], b[:, 0, 0], b[:, :, :1]
    t = trials(spark, a=a, b=b, row=row, one=one, column=column)
    with np.errstate(all="ignore"):
        for name, other in (("b", b), ("row", row[:, None]), ("one", one[:, None, None]), ("column", column)):
            np.testing.assert_allclose(run(stage("a", name, "y"), t), f(a, other).astype(float), err_msg=name)
        np.testing.assert_allclose(run(stage("one", "a", "y"), t), f(one[:, None, None], a).astype(float))


def test_comparisons_with_nan_are_false(spark):
    t = trials(spark, a=ODD, b=ODD)
    for stage, f in BINARY[-3:]:
        np.testing.assert_array_equal(run(stage("a", "b", "y"), t), f(ODD, ODD).astype(float))


def test_threshold_and_cdf(spark):
    t = trials(spark, x=X, limit=np.array([0.0, 1.0, -1.0]))
    np.testing.assert_array_equal(run(elementwise.Threshold("x", 0.5, "y"), t), (X > 0.5).astype(float))
    np.testing.assert_array_equal(run(elementwise.Threshold("x", "limit", "y"), t), (X > np.array([0, 1, -1])[:, None, None]).astype(float))
    half = np.maximum(X, 0) / 2
    np.testing.assert_allclose(run(elementwise.Cdf("x", "y", "chi2", df=4), t), np.where(X > 0, 1 - np.exp(-half) * (1 + half), 0), atol=1e-12)
    with pytest.raises(ValueError):
        elementwise.Cdf("x", "y", "chi2")


def kurt(x, axis):
    m = x - x.mean(axis=axis, keepdims=True)
    return (m**4).mean(axis=axis) / (m**2).mean(axis=axis) ** 2 - 3


def skew(x, axis):
    m = x - x.mean(axis=axis, keepdims=True)
    return (m**3).mean(axis=axis) / (m**2).mean(axis=axis) ** 1.5


@pytest.mark.parametrize("stage,f", [
    (reduce.Max, np.max), (reduce.Min, np.min), (reduce.Mean, np.mean), (reduce.Std, np.std), (reduce.Var, np.var), (reduce.Sum, np.sum), (reduce.Kurtosis, kurt), (reduce.Skewness, skew),
])
@pytest.mark.parametrize("axis", [0, 1, 2, -1])
def test_reductions(spark, stage, f, axis):
    x = np.random.default_rng(1).normal(size=(3, 2, 3, 4))
    t = trials(spark, x=x)
    inner = axis + 1 if axis >= 0 else axis
    np.testing.assert_allclose(run(stage("x", "y", axis=axis), t), f(x, axis=inner), rtol=1e-9, atol=1e-12)


def test_whole_reductions_and_options(spark):
    t = trials(spark, x=X)
    np.testing.assert_allclose(run(reduce.Mean("x", "y"), t), X.mean(axis=(1, 2)))
    np.testing.assert_allclose(run(reduce.Sum("x", "y"), t), X.sum(axis=(1, 2))[:, None])
    assert reduce.Max("x", "y", axis=1, keepdims=True).infer((2, 4)) == (2, 1)
    np.testing.assert_allclose(run(reduce.Var("x", "y", axis=1, ddof=1), t), X.var(axis=2, ddof=1))
    with pytest.raises(ValueError):
        reduce.Var("x", "y", axis=0, ddof=2).infer((2, 4))
    n = 4
    g = skew(X, 2) * np.sqrt(n * (n - 1)) / (n - 2)
    np.testing.assert_allclose(run(reduce.Skewness("x", "y", axis=1, bias=False), t), g)
    k = ((n + 1) * kurt(X, 2) + 6) * (n - 1) / ((n - 2) * (n - 3))
    np.testing.assert_allclose(run(reduce.Kurtosis("x", "y", axis=1, bias=False, fisher=False), t), k + 3)


def test_nan_in_reductions(spark):
    x = np.array([[1.0, np.nan, 3.0]])
    t = trials(spark, x=x)
    assert np.isnan(run(reduce.Min("x", "y"), t)[0]) and np.isnan(run(reduce.Max("x", "y"), t)[0])
    assert np.isnan(run(reduce.Kurtosis("x", "y"), t)[0])
    assert run(reduce.Skewness("x", "y", nan_policy="omit"), t)[0] == pytest.approx(0)
    with pytest.raises(Exception, match="NaN"):
        run(reduce.Skewness("x", "y", nan_policy="raise"), t)
    assert np.isnan(run(reduce.Kurtosis("x", "y"), trials(spark, x=np.ones((1, 5))))[0])


def test_covariance_and_slope(spark):
    t = trials(spark, x=X)
    np.testing.assert_allclose(run(reduce.Covariance("x", "y", 0.1), t), [(np.cov(x) + 0.1 * np.eye(2)) / 1.1 for x in X])
    np.testing.assert_allclose(run(reduce.Covariance("v", "y"), trials(spark, v=X[:, 0]))[:, 0, 0], X[:, 0].var(axis=1, ddof=1))
    time = np.linspace(0, 4 / 10, 4)
    np.testing.assert_allclose(run(reduce.Slope("x", "y", fs=10), t)[..., 0], [[np.polyfit(time, c, 1)[0] for c in x] for x in X])
    assert reduce.Slope("x", "y", axis=0).infer((2, 4)) == (4, 1)


def windows(x, n, stride):
    return np.stack([x[..., i : i + n] for i in range(0, x.shape[-1] - n + 1, stride)], axis=-2)


def test_moving_operators(spark):
    t = trials(spark, x=X, z=X * 2)
    np.testing.assert_array_equal(run(shape.Transpose("x", "y"), t), X.transpose(0, 2, 1))
    np.testing.assert_array_equal(run(shape.Reshape("x", "y", (4, -1)), t), X.reshape(3, 4, 2))
    np.testing.assert_array_equal(run(shape.Epoch("x", "y", 2, 1), t), windows(X, 2, 1))
    np.testing.assert_array_equal(run(shape.Epoch("x", "y", 1, axis=0), t), X[:, :, None])
    np.testing.assert_array_equal(run(shape.Concatenation("x", "z", "y", axis=0), t), np.concatenate([X, 2 * X], axis=1))
    np.testing.assert_array_equal(run(shape.Concatenation("x", "z", "y", axis=1), t), np.concatenate([X, 2 * X], axis=2))
    np.testing.assert_array_equal(run(shape.TensorStack("x", "z", "y", axis=1), t), np.stack([X, 2 * X], axis=2))
    np.testing.assert_array_equal(run(shape.Stack(["x", "z", "x"], "y"), t), np.stack([X, 2 * X, X], axis=1))
    np.testing.assert_array_equal(run(shape.Extract("x", (1, [3, 0]), "y"), t), X[:, 1:2][:, :, [3, 0]])
    np.testing.assert_array_equal(run(shape.Extract("x", (1, 2), "y", reduce_dims=True), t), X[:, 1, 2])
    wide = trials(spark, x=X, v=X[:, 0])
    np.testing.assert_array_equal(run(shape.Concatenation("x", "v", "y"), wide), np.concatenate([X, X[:, :1]], axis=1))


@pytest.mark.parametrize("mode", ["constant", "edge", "linear_ramp", "maximum", "mean", "median", "minimum", "reflect", "symmetric", "wrap"])
def test_pad(spark, mode):
    np.testing.assert_allclose(run(shape.Pad("x", "y", ((1, 0), (2, 1)), mode), trials(spark, x=X)), np.stack([np.pad(x, ((1, 0), (2, 1)), mode) for x in X]))


def test_pad_with_a_function_and_constants(spark):
    def fill(vector, width, axis, kwargs):
        vector[: width[0]] = -7

    t = trials(spark, x=np.ones((1, 1)))
    np.testing.assert_array_equal(run(shape.Pad("x", "y", 1), t), [[0, 1, 0]])
    np.testing.assert_array_equal(run(shape.Pad("x", "y", (1, 0), fill), t), [[-7, 1]])
    np.testing.assert_array_equal(run(shape.Pad("x", "y", 1, constant_values=((4, 5),)), t), [[4, 1, 5]])


def test_baseline(spark):
    x = np.random.default_rng(44).normal(size=(2, 5, 10))
    t = trials(spark, x=x)
    np.testing.assert_allclose(run(shape.BaselineCorrection("x", "y", (0, 10)), t), x - x.mean(axis=2, keepdims=True))
    np.testing.assert_allclose(run(shape.BaselineCorrection("x", "y"), t), x - x[:, :, :-1].mean(axis=2, keepdims=True))
    np.testing.assert_allclose(run(shape.BaselineCorrection("x", "y", (1, 3), axis=0), t), x - x[:, 1:3].mean(axis=1, keepdims=True))
    with pytest.raises(ValueError):
        shape.BaselineCorrection("x", "y", (5, 2)).infer((5, 10))


def test_ring_buffer_and_running_average(spark):
    x = np.arange(12.0).reshape(6, 2)
    t = trials(spark, x=x, flag=np.array([1.0, 0, 1, 1, 0, 1]))
    avg = run(shape.RunningAverage("x", "y", 3, "trial_id"), t)
    np.testing.assert_allclose(avg, [x[max(0, i - 2) : i + 1].mean(0) for i in range(6)])
    held = [r[0] for r in shape.Enqueue("x", "y", 2, "trial_id").apply(t).df.orderBy("trial_id").select("y").collect()]
    assert held == [x[max(0, i - 1) : i + 1].tolist() for i in range(6)]
    gated = [r[0] for r in shape.Enqueue("x", "y", 2, "trial_id", flag="flag").apply(t).df.orderBy("trial_id").select("y").collect()]
    pushed = [[0], [0], [0, 2], [2, 3], [2, 3], [3, 5]]
    assert gated == [x[p].tolist() for p in pushed]
    none = shape.Enqueue("x", "y", 2, "trial_id", flag="flag").apply(trials(spark, x=x[:1], flag=np.zeros(1)))
    assert none.df.first()["y"] == []


def test_filters(spark):
    x = np.random.default_rng(44).integers(-10, 10, (2, 30, 30)).astype(float)
    t = trials(spark, x=x)
    for kind in ("ba", "sos"):
        d = signal.FilterDesign.butter(4, (8, 35), "bandpass", kind, 250.0)
        b, a = iir.transfer(iir.digital(iir.butterworth(4), (8, 35), "bandpass", 250.0))
        np.testing.assert_allclose(run(signal.Filter("x", d, "y", axis=0), t), np.moveaxis(iir.lfilter(b, a, np.moveaxis(x, 1, -1)), -1, 1), atol=1e-6)
        np.testing.assert_allclose(run(signal.FiltFilt("x", d, "y", axis=1), t).shape, x.shape)
    fir = signal.FilterDesign.fir(128.0, 1, 40, phase="minimum")
    np.testing.assert_allclose(run(signal.Filter("x", fir, "y", axis=1), t)[1, 2], np.convolve(x[1, 2], fir.coefficients)[:30])
    with pytest.raises(TypeError):
        signal.FiltFilt("x", fir, "y")
    with pytest.raises(ValueError):
        signal.Filter("x", signal.FilterDesign.butter(2, 10, implementation="zpk", fs=100), "y")
    with pytest.raises(ValueError):
        signal.FiltFilt("x", signal.FilterDesign.butter(4, (8, 35), "bandpass", "ba", 250.0), "y").infer((30, 20))


def test_resample(spark):
    x = np.random.default_rng(44).normal(size=(3, 3, 3))
    up = run(signal.Resample("x", 2, "y", axis=1), trials(spark, x=x))
    np.testing.assert_allclose(up[:, :, ::2], x, atol=1e-12)


def test_normalisation_and_selection(spark):
    rng = np.random.default_rng(44)
    x, y = rng.normal(size=(20, 6)), np.arange(20) % 4
    x[:, 2] += y
    x[:, 5] += 3 * y
    t = trials(spark, y, x=x)
    np.testing.assert_allclose(run(features.ZScore("x", "y"), t), (x - x.mean()) / x.std(ddof=1))
    np.testing.assert_allclose(run(features.FeatureNormalization("x", "y"), t), (x - x.mean(0)) / x.std(0))
    np.testing.assert_allclose(run(features.FeatureNormalization("x", "y", "min-max"), t), (x - x.min(0)) / np.ptp(x, axis=0))
    np.testing.assert_allclose(run(features.FeatureNormalization("x", "y", "mean-norm"), t), (x - x.mean(0)) / np.ptp(x, axis=0))
    np.testing.assert_allclose(run(features.FeatureSelection("x", "y", 2), t), x[:, [2, 5]])
    np.testing.assert_allclose(run(features.FeatureSelection("x", "y", 6), t), x)
    with pytest.raises(ValueError):
        features.FeatureSelection("x", "y", 7).infer((6,))


def spd_set(rng, m, n):
    return spd.covariance(rng.normal(size=(m, n, 4 * n)), 0.001)


def test_riemannian_operators(spark):
    rng = np.random.default_rng(42)
    c = spd_set(rng, 16, 4)
    y = np.arange(16) % 2
    c[y == 1] *= 4
    t = trials(spark, y, c=c)
    means = [spd.mean(c[y == k]) for k in (0, 1)]
    want = np.argmin([spd.distance(m, c) for m in means], axis=0)
    np.testing.assert_array_equal(run(riemann.RiemannMdm("c", "y", 2), t), want)
    np.testing.assert_allclose(run(riemann.TangentSpace("c", "y"), t), spd.tangent(c, spd.mean(c)), atol=1e-6)
    np.testing.assert_allclose(riemann.karcher_mean(t, "c", most=1), spd.mean(c), atol=1e-7)
    both = trials(spark, a=c[:3], s=np.stack([c[3:6], c[6:9], c[9:12]]))
    np.testing.assert_allclose(run(riemann.RiemannDistance("a", "s", "y"), both), [[[spd.distance(c[i], m) for m in c[3 + 3 * i : 6 + 3 * i]]] for i in range(3)])
    np.testing.assert_allclose(run(riemann.RiemannMean("s", "y"), both)[0], spd.mean(c[3:6]), atol=1e-7)
    with pytest.raises(ValueError):
        riemann.RiemannMdm("c", "y", 3).fit(t)


def test_potato_rejects_an_outlier(spark):
    c = spd_set(np.random.default_rng(1), 30, 3)
    c[7] *= 1000
    got = run(riemann.RiemannPotato("c", "y", 3.0), trials(spark, c=c))
    assert got[7] == 0 and got.sum() >= 27


def test_rebias(spark):
    c = spd_set(np.random.default_rng(2), 8, 3)
    t = trials(spark, np.arange(8) % 2, c=c)
    start = spd.mean(c)
    fitted = riemann.AdaptiveRebiasFit("c", "y", "trial_id", update_rate=0.2).fit(t)
    got = values(fitted.apply(t), "y")
    bias = start
    for i in range(8):
        w = spd.invsqrtm(bias)
        np.testing.assert_allclose(got[i], w @ c[i] @ w, atol=1e-6)
        bias = spd.geodesic(bias, c[i], 0.2)
    np.testing.assert_allclose(values(riemann.AdaptiveRebias("c", "y", start, 0, "trial_id", update_rate=0.0).apply(t), "y")[5], spd.invsqrtm(start) @ c[5] @ spd.invsqrtm(start), atol=1e-8)
    blocks = riemann.AdaptiveRebiasFit("c", "y", "trial_id").recentred(t, "label")
    np.testing.assert_allclose(spd.mean(values(blocks, "y")[::2]), np.eye(3), atol=1e-6)


def test_spatial_filters(spark):
    rng = np.random.default_rng(44)
    x, y = rng.normal(size=(20, 5, 26)), np.arange(20) % 2
    x[y == 1, 0] *= 4
    t = trials(spark, y, x=x)
    assert run(features.Csp("x", "y", 4), t).shape == (20, 4, 26)
    power = run(features.Csp("x", "y", 1), t).var(axis=(1, 2))
    low, high = sorted((power[y == 0], power[y == 1]), key=np.mean)
    assert low.max() < high.min()
    assert run(features.Csp("x", "y", 2, cov_est="epoch", reg=0.1), t).shape == (20, 2, 26)
    assert run(features.XDawnCovariance("x", "y", 2), t).shape == (20, 8, 8)
    with pytest.raises(ValueError):
        features.Csp("x", "y").fit(trials(spark, np.zeros(20), x=x))


@pytest.mark.parametrize("learner", [lambda: classify.lda("lsqr"), lambda: classify.lda("lsqr", 0.2), lambda: classify.lda("lsqr", "auto"), classify.svm, classify.logistic_regression])
def test_classifiers(spark, learner):
    rng = np.random.default_rng(3)
    y = np.arange(60) % 3
    x = rng.normal(size=(60, 4)) + 4 * np.eye(4)[y]
    t = trials(spark, y, x=x)
    model = learner()
    stage = classify.Classifier("x", "y", model, "p" if hasattr(model, "predict_proba") else None, 3)
    out = stage.fit(t).apply(t)
    got = values(out, "y")
    assert (got == y).mean() > 0.9
    np.testing.assert_array_equal(got, learner().fit(x, y.astype(float)).predict(x))
    if stage.proba:
        np.testing.assert_allclose(values(out, "p").sum(1), 1)
    with pytest.raises(ValueError):
        classify.Classifier("x", "y", learner(), num_classes=2).fit(t)


def test_states_and_potatoes(spark):
    rng = np.random.default_rng(4)
    c = spd_set(rng, 40, 3)
    y = np.arange(40) % 2
    c[y == 1] = c[y == 1] * 9
    t = trials(spark, y, c=c)
    out = classify.PatternState("c", "y", "p", k_sel_thresh=0.95, k_range=(2, 3)).fit(t).apply(t)
    got = values(out, "y")
    assert len(set(got[y == 0])) == 1 and len(set(got[y == 1])) == 1 and got[0] != got[1]
    np.testing.assert_allclose(values(out, "p").sum(1), 1)
    fitted = classify.MultiPotatoFit("c", "y", 2, threshold=3.0).fit(t)
    got = values(fitted.apply(t), "y")
    assert set(got[y == 0]) <= {got[0], 2.0} and got[0] != got[1]
    assert fitted.model.predict(np.array([1e4 * np.eye(3)]))[0] == 2
    before = fitted.model.centers.copy()
    fitted.model.update(c[:1], 0.5)
    assert not np.allclose(before, fitted.model.centers)


def test_folds_metrics_and_cross_validation(spark):
    rng = np.random.default_rng(5)
    y = np.arange(31) % 2
    t = trials(spark, y, x=rng.normal(size=(31, 3)) + 5 * np.eye(3)[y])
    for seed in (None, 3):
        folds = classify.stratified_folds(t.df, "label", "trial_id", 4, seed).groupBy("label", "fold").count().collect()
        for k in (0, 1):
            sizes = [r["count"] for r in folds if r["label"] == k]
            assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    cv = classify.CrossValidation(lambda: Plan([classify.Classifier("x", "y", classify.lda("lsqr"))]), "y", folds=3)
    assert cv.run(t) > 0.9
    df = spark.createDataFrame([(1.0, 1.0, [0.1, 0.9]), (1.0, 0.0, [0.6, 0.4]), (0.0, 0.0, [0.8, 0.2]), (0.0, 1.0, [0.3, 0.7]), (1.0, 1.0, [0.2, 0.8])], "y double, p double, q array<double>")
    assert classify.metric(df, "y", "p") == pytest.approx(0.6)
    assert classify.metric(df, "y", "p", "precision") == pytest.approx(2 / 3)
    assert classify.metric(df, "y", "p", "recall") == pytest.approx(2 / 3)
    assert classify.metric(df, "y", "p", "f1") == pytest.approx(2 / 3)
    assert classify.metric(df, "y", "p", "recall", average="macro") == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert classify.metric(df, "y", "p", "cross_entropy", "q") == pytest.approx(-np.mean(np.log([0.9, 0.4, 0.8, 0.3, 0.8])))


def test_plan(spark):
    t = trials(spark, np.arange(12) % 2, x=np.random.default_rng(6).normal(size=(12, 2, 8)))
    plan = Plan([riemann.RiemannMdm("cov", "y"), reduce.Covariance("f", "cov", 0.1), signal.FiltFilt("x", signal.FilterDesign.butter(1, 20, fs=100), "f"), reduce.Mean("x", "unused")])
    assert [type(s).__name__ for s in plan.ordered(t.shapes, ["y"])] == ["FiltFilt", "Covariance", "RiemannMdm"]
    assert plan.infer(t.shapes)["cov"] == (2, 2)
    fitted = plan.fit(t, ["y"])
    assert set(values(fitted.transform(t), "y")) <= {0.0, 1.0}
    with pytest.raises(ValueError, match="two producers"):
        Plan([reduce.Mean("x", "y"), reduce.Max("x", "y")]).infer(t.shapes)
    with pytest.raises(ValueError, match="depends on itself"):
        Plan([reduce.Mean("b", "a"), reduce.Mean("a", "b")]).infer(t.shapes)
    with pytest.raises(ValueError, match="nothing produces"):
        Plan([reduce.Mean("q", "a")]).infer(t.shapes)
    with pytest.raises(ValueError, match="fitted"):
        plan.transform(t)
    with pytest.raises(ValueError) as e:
        Plan([reduce.Mean("x", "m", axis=5)]).infer(t.shapes)
    assert "Mean" in e.value.__notes__[0]


def test_null_trials_stay_null(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 5.0])], "trial_id long, x array<double>")
    t = Trials(df, {"x": (2,)})
    for stage in (elementwise.Cdf("x", "y"), elementwise.Absolute("x", "y"), reduce.Mean("x", "y")):
        got = [r[0] for r in stage.apply(t).df.orderBy("trial_id").select("y").collect()]
        assert got[1] is None and got[0] is not None and got[2] is not None


def test_column_operators_stay_in_the_jvm(spark):
    t = trials(spark, x=X)
    plan = Plan([elementwise.Absolute("x", "a"), reduce.Mean("a", "m", axis=1), shape.Epoch("x", "e", 2)])
    text = plan.transform(t).df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
    fused = Plan([elementwise.Cdf("x", "a"), elementwise.Cdf("a", "b"), signal.Resample("b", 2, "c")])
    plan_text = fused.transform(t).df.select(F.col("c"))._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("ArrowEvalPython") == 1


def test_saved_updated_and_following_plans(spark, tmp_path):
    c = spd_set(np.random.default_rng(8), 20, 3)
    t = trials(spark, np.arange(20) % 2, c=c)
    plan = Plan([classify.PatternState("c", "y", k_selection="fixed", n_clusters=2), riemann.TangentSpace("c", "v", 0.1)])
    fitted = plan.fit(t)
    fitted.save(spark, f"file://{tmp_path}/plan")
    again = type(fitted).load(spark, f"file://{tmp_path}/plan")
    np.testing.assert_array_equal(values(again.transform(t), "v"), values(fitted.transform(t), "v"))
    before = fitted.operators[0].states.centers.copy()
    fitted.update(t, 0.3)
    assert not np.allclose(before, fitted.operators[0].states.centers)
    other = plan.updated("v", r=0.5)
    assert other.stages[1].r == 0.5 and plan.stages[1].r == 0.1
    with pytest.raises(AttributeError):
        plan.updated("v", nothing=1)


def test_means_by_label_without_collecting(spark):
    c = spd_set(np.random.default_rng(9), 14, 3)
    y = np.arange(14) % 3
    found = riemann.karcher_means(trials(spark, y, c=c), "c", most=1)
    for k in range(3):
        np.testing.assert_allclose(found[k], spd.mean(c[y == k]), atol=1e-7)
