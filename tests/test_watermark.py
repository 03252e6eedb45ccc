"""State in lists and buckets, event time with a watermark, and recordings that fall silent."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.numerics import spd
from kymo.operators import riemann, shape
from kymo.operators.base import Trials
from kymo.sources import streams
from kymo.streaming import operators as streaming

SCHEMA = "trial_id long, rec string, ts double, x array<double>, flag boolean"
EVENTS = "recording string, ts double, values array<double>, marker string"


def arriving(spark, folder, batches, schema):
    """A stream that delivers lists of rows, one list a micro-batch."""
    folder.mkdir(parents=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part={i:03}"))
        time.sleep(0.01)  # files are taken in the order of their times
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drained(spark, stream, folder):
    """(rows of all batches, the query)."""
    out = []
    q = streaming.to_sink(stream, lambda df, n: out.extend(df.collect()), str(folder / "state"), once=True).start()
    q.awaitTermination()
    return out, q


def shuffled(rows, key, seconds, seed):
    """Rows in an order in which each comes at most ``seconds`` late."""
    rng = np.random.default_rng(seed)
    return sorted(rows, key=lambda r: r[key] + rng.uniform(0, seconds * 0.99))


@pytest.fixture
def trials():
    rng = np.random.default_rng(1)
    return [(i, "ab"[i % 2], float(i // 4), rng.normal(size=2).tolist(), i % 3 == 0) for i in range(60)]


def test_out_of_order_trials_equal_batch(spark, tmp_path, trials):
    """Early, late and tied trials in micro-batches that cut ties apart: each comes up to 4 seconds late, and the watermark waits for 5."""
    batch = Trials(spark.createDataFrame(trials, SCHEMA).withColumn("f", F.col("flag").cast("double")), {"x": (2,), "f": ()})
    order = shuffled(trials, 2, 4.0, 2)
    push = [(-1, "z", 1000.0, [0.0, 0.0], True)]  # another recording moves the watermark past all
    stream = arriving(spark, tmp_path / "in", [order[:7], order[7:30], order[30:31], order[31:], push], SCHEMA)
    got, _ = drained(spark, streaming.running_average(stream, "x", 3, "rec", "ts", late_seconds=5), tmp_path / "1")
    # ties keep the order in which they came: the batch operator is given the same
    place = {r[0]: i for i, r in enumerate(order)}
    ranked = batch.df.withColumn("o", F.col("ts") + F.create_map(*[F.lit(x) for k, v in place.items() for x in (k, v * 1e-6)])[F.col("trial_id")])
    want = shape.RunningAverage("x", "y", 3, "o", ("rec",)).apply(batch.with_df(ranked)).df
    assert {r["trial_id"]: r["average"] for r in got if r["trial_id"] >= 0} == {r["trial_id"]: r["y"] for r in want.collect()}
    got, _ = drained(spark, streaming.ring_buffer(stream, "x", 3, "rec", "ts", flag="flag", late_seconds=5), tmp_path / "2")
    want = shape.Enqueue("x", "y", 3, "o", ("rec",), "f").apply(batch.with_df(ranked)).df
    assert {r["trial_id"]: r["buffer"] for r in got if r["trial_id"] >= 0} == {r["trial_id"]: r["y"] for r in want.collect()}


def test_out_of_order_matrices_equal_batch(spark, tmp_path):
    c = spd.covariance(np.random.default_rng(2).normal(size=(12, 2, 30)))
    rows = [(i, "a", float(i), c[i].ravel().tolist(), True) for i in range(12)]
    start = spd.mean(c)
    want = riemann.AdaptiveRebias("x", "y", start, 12, "ts", ("rec",), 0.1).apply(Trials(spark.createDataFrame(rows, SCHEMA), {"x": (2, 2)})).df
    stream = arriving(spark, tmp_path / "in", [rows[3:6], rows[:3], rows[9:], rows[6:9], [(-1, "z", 1000.0, [1.0, 0.0, 0.0, 1.0], True)]], SCHEMA)
    got, _ = drained(spark, streaming.adaptive_rebias(stream, "x", (2, 2), start, 12, "rec", "ts", late_seconds=20), tmp_path)
    got = {r["trial_id"]: r["recentred"] for r in got}
    for r in want.collect():
        np.testing.assert_allclose(got[r["trial_id"]], r["y"], atol=1e-9)


def test_what_comes_behind_the_watermark_is_dropped(spark, tmp_path):
    row = lambda i, ts: (i, "a", float(ts), [float(i)], True)
    batches = [[row(0, 10), row(1, 20)], [row(5, 40)], [row(2, 16), row(3, 14), row(4, 15)], [row(6, 100)]]
    got, q = drained(spark, streaming.running_average(arriving(spark, tmp_path / "in", batches, SCHEMA), "x", 2, "rec", "ts", late_seconds=5), tmp_path)
    # behind 20 the watermark is 15, and the batch with 40 has it: after that, trials at 15 and before are too late, the one at 16 isn't
    assert {r["trial_id"]: r["average"] for r in got} == {0: [0.0], 2: [1.0], 1: [1.5], 5: [3.0]}  # the one at 100 still waits
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"]) == 2


def test_windows_behind_a_watermark_equal_epochs(spark, tmp_path):
    """Samples, and markers that come before and after theirs, in any order."""
    rng = np.random.default_rng(5)
    rows = [(r, round(0.1 * i, 3), [float(i), rng.normal()], None) for r in "ab" for i in range(120)]
    said = [(r, t, None, m) for r, t, m in (("a", 0.45, "go"), ("a", 0.6, "go"), ("b", 2.0, "no"), ("b", 3.3, "go"), ("a", 3.3, "go"), ("b", 3.3, "go 2"), ("a", 11.85, "go"))]
    order = shuffled(rows + said, 1, 3.0, 6)
    batches = [order[i : i + 41] for i in range(0, len(order), 41)] + [[("z", 1e4, [0.0, 0.0], None)]]
    for i, bucket in enumerate((0.25, 7.0)):
        stream = arriving(spark, tmp_path / f"in{i}", batches, EVENTS)
        got, _ = drained(spark, streaming.marker_windows(stream, 6, "go", -0.2, late_seconds=3, bucket_seconds=bucket), tmp_path / f"{i}")
        signal = spark.createDataFrame([r[:3] for r in rows], "recording string, ts double, values array<double>")
        wanted = spark.createDataFrame([(r, t, m) for r, t, _, m in said if m.startswith("go")], "recording string, ts double, label string")
        want = sorted((r["recording"], r["label"], r["t0"], r["data"]) for r in streams.epochs(signal, wanted, 6, -0.2).collect())
        assert sorted(map(tuple, got)) == want and len(want) == 5


def test_a_batch_writes_what_is_new(spark, tmp_path):
    """Fifteen seconds of a recording, a second a micro-batch, all of which is held: rows of state that are written don't grow."""
    batches = [[("a", s + i / 50, [float(i)], None) for i in range(50)] for s in range(15)]
    got, q = drained(spark, streaming.marker_windows(arriving(spark, tmp_path / "in", batches, EVENTS), 10, "never"), tmp_path)
    state = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
    assert got == [] and len(state) == 15
    assert max(s["numRowsUpdated"] for s in state) <= 4  # the newest bucket, the clock, what is held
    assert state[-1]["numRowsTotal"] >= 15


def test_silent_recordings_are_forgotten(spark, tmp_path):
    """In event time: b falls silent and is forgotten once the watermark is far enough; when it speaks again its average begins anew."""
    row = lambda i, rec, ts: (i, rec, float(ts), [float(i)], True)
    batches = [[row(0, "a", 0), row(1, "b", 0)], [row(2, "a", 5), row(3, "b", 4)], [row(4, "a", 30)], [row(5, "a", 40)], [row(6, "b", 41), row(7, "a", 42)], [row(8, "a", 60)], [row(9, "a", 100)]]
    stream = arriving(spark, tmp_path / "in", batches, SCHEMA)
    got, _ = drained(spark, streaming.running_average(stream, "x", 3, "rec", "ts", late_seconds=1, expire_seconds=15), tmp_path / "1")
    means = {r["trial_id"]: r["average"][0] for r in got}
    assert means[3] == 2.0 and means[6] == 6.0 and means[2] == 1.0
    got, _ = drained(spark, streaming.running_average(stream, "x", 3, "rec", "ts", late_seconds=1), tmp_path / "2")
    assert {r["trial_id"]: r["average"][0] for r in got}[6] == pytest.approx((1 + 3 + 6) / 3)


def test_silence_by_the_clock(spark, tmp_path):
    folder = tmp_path / "in"
    row = lambda i: (i, "a", float(i), [float(i)], True)
    stream = arriving(spark, folder, [[row(0), row(1)]], SCHEMA)
    out = []
    q = streaming.to_sink(streaming.running_average(stream, "x", 9, "rec", "ts", expire_seconds=2), lambda df, n: out.extend(df.collect()), str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    end = time.monotonic() + 60
    while len(out) < 2 and time.monotonic() < end:
        time.sleep(0.1)
    gone = lambda: (p := q.lastProgress) and p["stateOperators"] and p["stateOperators"][0]["numRowsTotal"] == 0
    while not gone() and time.monotonic() < end:
        time.sleep(0.2)
    spark.createDataFrame([row(5)], SCHEMA).coalesce(1).write.parquet(str(folder / "part=late"))
    while len(out) < 3 and time.monotonic() < end:
        time.sleep(0.1)
    q.stop()
    assert [r["average"][0] for r in sorted(out, key=lambda r: r["trial_id"])] == [0.0, 0.5, 5.0]
