"""What makes held trials runs once over them, and a task of a pass keeps one Python process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import classify
from kymo.operators.base import BatchOperator, Moments, Trials, cached, moments_by


class Noted(BatchOperator):
    """Its input; writes down how many trials a call sees."""

    inputs, output = ("x",), "y"

    def __init__(self, path: str):
        self.path = path

    def infer(self, a):
        return a

    def batch(self, a):
        with open(self.path, "a") as f:
            f.write(f"{len(a)}\n")
        return a

    def seen(self) -> int:
        with open(self.path) as f:
            return sum(map(int, f))


def trials_of(spark, x, partitions=3):
    rows = [(i, None if v is None else np.ravel(v).tolist()) for i, v in enumerate(x)]
    return Trials(spark.createDataFrame(rows, "trial_id long, x array<double>").repartition(partitions), {"x": np.shape(x[0])}, label=None)


def test_held_trials_are_made_once(spark, tmp_path):
    noted = Noted(str(tmp_path / "seen"))
    x = [np.full(2, float(i)) if i % 5 or i == 0 else None for i in range(60)]
    made = noted.apply(trials_of(spark, x))
    with cached(made, "y") as held:
        for _ in range(2):
            assert held.df.count() == 49
            assert sorted(r["_c"][0] for r in held.df.collect()) == [float(i) for i, v in enumerate(x) if v is not None]
    assert noted.seen() == 49


def test_multi_potato_makes_its_matrices_four_times(spark, tmp_path):
    """For their mean, for the clusters, and for the potatoes with each trial's cluster beside it."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(80, 3, 9)) * np.where(np.arange(80) % 2, 4.0, 1.0)[:, None, None]
    noted = Noted(str(tmp_path / "seen"))
    fitted = classify.MultiPotatoFit("y", "state", 2).fit(noted.apply(trials_of(spark, list(a @ np.swapaxes(a, 1, 2) / 9))))
    assert noted.seen() <= 4 * 80
    sizes = sorted(np.trace(c) for c in fitted.model.centers)
    assert sizes[1] > 8 * sizes[0]


@pytest.mark.parametrize("partitions", [1, 40])
def test_moments_of_a_pass_need_no_rdd(spark, monkeypatch, partitions):
    """A function of an RDD would keep a second Python process beside each of the pass."""
    x = np.random.default_rng(1).normal(size=(300, 3)) + 1e6
    t = trials_of(spark, [*x, None], partitions)
    want = Moments.of(x, True)

    def refused(self):
        raise AssertionError("an RDD beside the pass")

    monkeypatch.setattr(type(t.df), "rdd", property(refused))
    found = moments_by(t, "x", [], True)
    assert list(found) == [()] and found[()].count == 300
    np.testing.assert_allclose(found[()].mean, want.mean, rtol=1e-12)
    np.testing.assert_allclose(found[()].centred, want.centred, rtol=1e-6, atol=1e-6)
    assert moments_by(t.with_df(t.df.filter(F.col("x").isNull())), "x", [], True) == {}
