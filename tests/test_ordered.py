"""Order within recordings that lie over many tasks: equal to one task a recording."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import ordered, shape
from kymo.operators.base import Trials
from kymo.sources import streams


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 16)


def rows(n, seed=0, recordings=("a", "b", None)):
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    return [(int(i), recordings[int(i) % 7 % len(recordings)], float(order[i]), [float(v) for v in rng.normal(size=2)], float(rng.random() < 0.2) if i % 11 else None) for i in range(n)]


def as_trials(spark, some):
    return Trials(spark.createDataFrame(some, "trial_id long, rec string, ts double, x array<double>, flag double"), {"x": (2,), "flag": ()})


@pytest.mark.parametrize("by", [("rec",), ()])
@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_buffers_and_averages(spark, small_blocks, by, n):
    trials = as_trials(spark, rows(n))
    for make in (lambda s: shape.RunningAverage("x", "y", 7, "ts", by, split=s), lambda s: shape.RunningAverage("flag", "y", 3, "ts", by, split=s),
                 lambda s: shape.Enqueue("x", "y", 5, "ts", by, split=s), lambda s: shape.Enqueue("x", "y", 5, "ts", by, "flag", split=s)):
        got, want = ({r["trial_id"]: r["y"] for r in make(s).apply(trials).df.select("trial_id", "y").collect()} for s in (True, False))
        assert got == want and len(got) == n


def test_runs_without_pushes(spark, small_blocks):
    """Blocks in which nothing is pushed hold what was pushed long before."""
    some = [(i, "a", float(i), [float(i), 0.0], 1.0 if i in (3, 4, 150) else 0.0) for i in range(300)]
    trials = as_trials(spark, some)
    got = {r["trial_id"]: [v[0] for v in r["y"]] for r in shape.Enqueue("x", "y", 2, "ts", flag="flag").apply(trials).df.collect()}
    assert got == {i: [] if i < 3 else [3.0] if i < 4 else [3.0, 4.0] if i < 150 else [4.0, 150.0] for i in range(300)}


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame(rows(500), "trial_id long, rec string, ts double, x array<double>, flag double").repartition(7)
    got = ordered.earlier(df, ["rec"], ["ts"], {"n": F.lit(True), "k": F.col("flag") == 1}, partitions=9).orderBy("rec", "n").collect()
    seen, pushed = {}, {}
    for r in got:
        assert r["n"] == seen.get(r["rec"], 0) and r["k"] == pushed.get(r["rec"], 0)
        seen[r["rec"]] = r["n"] + 1
        pushed[r["rec"]] = r["k"] + (r["flag"] == 1)
    assert sum(seen.values()) == 500 and sorted(r["ts"] for r in got if r["rec"] == "a") == [r["ts"] for r in got if r["rec"] == "a"]


def test_windows_and_epochs(spark):
    rng = np.random.default_rng(3)
    signal = spark.createDataFrame([(r, float(t), [float(t), float(k)]) for k, r in enumerate("ab") for t in rng.permutation(300)], "recording string, ts double, values array<double>")
    key = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    for size, stride in ((7, None), (10, 3), (3, 10)):
        assert key(streams.count_windows(signal, size, stride, split=True), "recording", "window", "t0", "data") == key(streams.count_windows(signal, size, stride), "recording", "window", "t0", "data")
    said = [("a", 5.0, 1), ("a", 5.0, 2), ("a", 4.5, 3), ("b", -9.0, 4), ("b", 299.0, 5), ("b", 295.0, 6), ("c", 1.0, 7), ("a", 500.0, 8), ("a", None, 9)]
    markers = spark.createDataFrame(said, "recording string, ts double, label long")
    for start in (0.0, -0.2, 0.3):
        got = key(streams.epochs(signal, markers, 5, start, split=True), "label", "t0", "marker_ts", "data")
        assert got == key(streams.epochs(signal, markers.filter("ts is not null"), 5, start), "label", "t0", "marker_ts", "data") and len(got) >= 4


def test_one_long_recording(spark):
    """Two million samples of one recording: no task holds more than its share."""
    n = 2_000_000
    df = spark.range(n).select(F.col("id").alias("trial_id"), F.array(F.col("id").cast("double")).alias("x"))
    began = time.perf_counter()
    out = shape.RunningAverage("x", "y", 20, "trial_id").apply(Trials(df, {"x": (1,)})).df
    assert out.agg(F.sum(F.abs(F.get("y", F.lit(0)) - F.when(F.col("trial_id") < 19, F.col("trial_id") / 2).otherwise(F.col("trial_id") - 9.5)))).first()[0] < 1e-3
    assert time.perf_counter() - began < 120
