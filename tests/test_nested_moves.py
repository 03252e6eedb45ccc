"""Chains of operators: elements move once, inputs are evaluated once, and Python functions accept any of them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import elementwise, reduce, shape
from kymo.operators.base import Trials
from kymo.plans.pipeline import Plan


@pytest.fixture
def trials(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 4, 16))
    rows = [(i, i % 2, v.ravel().tolist()) for i, v in enumerate(x)]
    spark.createDataFrame([*rows, (300, 0, None)], "trial_id long, label int, x array<double>").write.parquet(f"{tmp_path}/t")
    return x, Trials(spark.read.parquet(f"{tmp_path}/t"), {"x": (4, 16)})


def got(t, name):
    rows = t.df.select("trial_id", name).orderBy("trial_id").collect()
    assert rows[-1][1] is None
    return np.array([r[1] for r in rows[:-1]]).reshape(len(rows) - 1, *t.shape(name))


def windows(x):
    return np.stack([x[..., s : s + 8] for s in (0, 4, 8)], axis=-2)


def test_moves_compose(trials):
    x, t = trials
    t = shape.Epoch("x", "e", 8, 4)(t)
    t = shape.Transpose("e", "a", (1, 0, 2))(t)
    t = shape.Reshape("a", "r", (6, -1))(t)
    t = shape.Extract("r", ([5, 0], slice(0, 16, 3)), "p")(t)
    t = shape.Transpose("p", "y")(t)
    want = windows(x).transpose(0, 2, 1, 3).reshape(len(x), 6, 16)[:, [5, 0]][:, :, ::3].transpose(0, 2, 1)
    assert np.array_equal(got(t, "y"), want)
    assert t.moved["y"][0] == "x"


def test_a_source_that_changes_is_not_used(trials):
    x, t = trials
    t = shape.Transpose("x", "y")(t)
    t = elementwise.Absolute("x", "x")(t)
    t = shape.Transpose("y", "z")(t)
    assert np.array_equal(got(t, "z"), x)
    t = shape.Transpose("z", "z")(t)
    assert np.array_equal(got(t, "z"), x.transpose(0, 2, 1))


def test_python_after_nested_expressions(trials):
    x, t = trials
    plan = Plan([
        shape.Epoch("x", "e", 8, 4), shape.Transpose("e", "w", (1, 0, 2)), elementwise.Absolute("w", "b"), reduce.Std("b", "d", axis=0),
        shape.BaselineCorrection("d", "c", (0, 3)), reduce.Covariance("c", "y", 0.1), shape.Transpose("y", "z"), reduce.Covariance("z", "v", 0.1),
    ])
    d = np.abs(windows(x).transpose(0, 2, 1, 3)).std(axis=1)
    c = d - d[..., :3].mean(axis=-1, keepdims=True)
    cov = lambda a: (np.stack([np.cov(m) for m in a]) + 0.1 * np.eye(4)) / 1.1
    assert np.allclose(got(plan.transform(t, ["v"]), "v"), cov(cov(c).transpose(0, 2, 1)))


def test_scalars_are_evaluated_once(trials):
    x, t = trials
    plan = Plan([reduce.Max("x", "m"), elementwise.Divide("x", "m", "y"), reduce.Mean("y", "n"), elementwise.Subtract("n", "y", "z")])
    y = x / x.max(axis=(1, 2), keepdims=True)
    assert np.allclose(got(plan.transform(t, ["z"]), "z"), y.mean(axis=(1, 2), keepdims=True) - y)


def test_depth_costs_little(trials):
    """Each further operator on the ones before adds its own work, not a multiple of theirs."""
    _, t = trials

    def seconds(depth):
        out = shape.Pad("x", "p0", ((0, 0), (2, 2)), "reflect")(t)
        for i in range(depth):
            out = shape.BaselineCorrection(f"p{i}", f"p{i + 1}", (0, 5), axis=i % 2)(out) if i % 2 else shape.Concatenation(f"p{i}", "x", f"p{i + 1}", axis=1)(out)
        began = time.perf_counter()
        out.df.select(F.sum(F.hash(f"p{depth}"))).collect()
        return time.perf_counter() - began

    seconds(1)
    assert seconds(5) < 5 * seconds(1) + 3
