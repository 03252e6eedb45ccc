"""Recordings, markers, XDF files and streams; streaming results equal batch results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.numerics import spd
from kymo.operators import riemann, shape
from kymo.operators.base import Trials
from kymo.sources import streams, xdf
from kymo.streaming import operators as streaming


def signal_rows(n=40, recordings=("r1", "r2"), channels=2):
    rng = np.random.default_rng(3)
    return [(r, 100.0 * k + 0.1 * i, [float(v) for v in rng.normal(size=channels)]) for k, r in enumerate(recordings) for i in range(n)]


def test_epochs_by_count(spark):
    rows = signal_rows()
    signal = spark.createDataFrame(rows, "recording string, ts double, values array<double>").repartition(5)
    markers = [("r1", 0.55, "a"), ("r1", 1.0, "b"), ("r1", 1.05, "a"), ("r1", 3.75, "late"), ("r2", 101.0, "b"), ("r3", 0.0, "a")]
    df = spark.createDataFrame(markers, "recording string, ts double, label string")
    got = {(r["recording"], r["marker_ts"]): r for r in streams.epochs(signal, df, 5, 0.2).collect()}
    want = {}
    for rec, ts, label in markers:
        own = [x for x in rows if x[0] == rec and x[1] >= ts + 0.2][:5]
        if len(own) == 5:
            want[rec, ts] = (own[0][1], np.array([x[2] for x in own]).T.ravel().tolist(), label)
    assert {k: (r["t0"], r["data"], r["label"]) for k, r in got.items()} == want
    one = streams.epochs(signal, df, 5, 0.2, channels=[1])
    assert {len(r["data"]) for r in one.collect()} == {5}
    assert streams.as_trials(one, 1, 5).shape("data") == (1, 5)


def test_target_labels(spark):
    m = streams.marker_json
    rows = [("r", 0.0, m(flash=[1])), ("r", 1.0, m(target=3)), ("r", 2.0, m(flash=[3])), ("r", 3.0, m(flash=[1, 2])), ("r", 4.0, m(target=1)), ("r", 5.0, m(flash=[1, 2])), ("q", 2.0, m(flash=[3])), ("q", 3.0, "plain")]
    df = spark.createDataFrame(rows, "recording string, ts double, marker string")
    got = {(r["recording"], r["ts"]): r["label"] for r in streams.target_labels(df).collect()}
    assert got == {("r", 2.0): "target", ("r", 3.0): "non-target", ("r", 5.0): "target"}
    tasks = streams.task_markers(df.withColumn("marker", F.when(F.col("marker") == "plain", "left").otherwise("right")), ["left", "right"])
    assert sorted({(r["marker"], r["label"]) for r in tasks.collect()}) == [("left", 0), ("right", 1)]
    assert streams.matching_markers(df, "pla.n").count() == 1 and streams.matching_markers(df, "lain").count() == 0


def test_polling_and_count_windows(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", float(i)) for i in range(12)], "id long, label string, marker_ts double")
    assert sorted(r["id"] for r in streams.nth_of_class(df, 2).collect()) == [3, 4, 5]
    assert [r["id"] for r in streams.nth_of_class(df, 2, by_class=False).collect()] == [1]
    rows = signal_rows(11, ("r",), 1)
    cut = streams.count_windows(spark.createDataFrame(rows, "recording string, ts double, values array<double>"), 4, 3)
    flat = [r[2][0] for r in rows]
    assert [r["data"] for r in cut.orderBy("window").collect()] == [flat[i : i + 4] for i in (0, 3, 6)]


def test_xdf_round_trip(spark, tmp_path):
    stamps = [float(i) for i in range(10)]
    eeg = xdf.Stream(1, "amp", "EEG", "float32", 2, 1.0, ["C3", "C4"], stamps, [[i, -i] for i in range(10)], [(0.0, 0.5), (10.0, 0.5)])
    few = xdf.Stream(2, "m", "Markers", "string", 1, 0.0, [], [1.0], [["x"]])
    more = xdf.Stream(3, "m2", "Markers", "string", 1, 0.0, [], [2.0, 4.0], [["go"], ["stop"]])
    (tmp_path / "a.xdf").write_bytes(xdf.write_xdf([eeg, few, more]))
    (tmp_path / "b.xdf").write_bytes(xdf.write_xdf([eeg, few]))
    df = xdf.read_xdf(spark, str(tmp_path))
    signal, markers = xdf.signal_and_markers(df)
    rows = [r for r in signal.orderBy("recording", "ts").collect() if r["recording"].endswith("a.xdf")]
    assert [r["values"] for r in rows] == [[float(i), float(-i)] for i in range(10)]
    np.testing.assert_allclose([r["ts"] for r in rows], np.arange(10) + 0.5)
    assert sorted((r["recording"][-5:], r["marker"]) for r in markers.collect()) == [("a.xdf", "go"), ("a.xdf", "stop"), ("b.xdf", "x")]
    with pytest.raises(ValueError):
        xdf.parse(b"nope")
    with pytest.raises(ValueError):
        xdf.parse(xdf.write_xdf([eeg])[:-3])


def stream_of(spark, tmp_path, df, parts):
    """A stream that delivers ``df`` in ``parts`` micro-batches, by ts."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = df.orderBy("ts").collect()
    for i in range(parts):
        some = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(some, df.schema).coalesce(1).write.parquet(str(folder / f"part={i}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drained(spark, stream, tmp_path):
    out = []
    streaming.to_sink(stream, lambda df, n: out.extend(df.collect()), str(tmp_path / "state"), once=True).start().awaitTermination()
    return out


def test_streamed_buffers_equal_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i), [float(i), i * 2.0], i % 3 == 0) for i in range(14)]
    df = spark.createDataFrame(rows, "trial_id long, rec string, ts double, x array<double>, flag boolean")
    batch = Trials(df.withColumn("f", F.col("flag").cast("double")), {"x": (2,), "f": ()})
    stream = stream_of(spark, tmp_path, df, 4)
    (tmp_path / "1").mkdir(), (tmp_path / "2").mkdir()
    got = {r["trial_id"]: r["average"] for r in drained(spark, streaming.running_average(stream, "x", 3, "rec", "ts"), tmp_path / "1")}
    assert got == {r["trial_id"]: r["y"] for r in shape.RunningAverage("x", "y", 3, "ts", ("rec",)).apply(batch).df.collect()}
    got = {r["trial_id"]: r["buffer"] for r in drained(spark, streaming.ring_buffer(stream, "x", 2, "rec", "ts", flag="flag"), tmp_path / "2")}
    assert got == {r["trial_id"]: r["y"] for r in shape.Enqueue("x", "y", 2, "ts", ("rec",), "f").apply(batch).df.collect()}


def test_streamed_rebias_equals_batch(spark, tmp_path):
    c = spd.covariance(np.random.default_rng(2).normal(size=(8, 2, 30)))
    df = spark.createDataFrame([(i, "a", float(i), c[i].ravel().tolist()) for i in range(8)], "trial_id long, rec string, ts double, c array<double>")
    start = spd.mean(c)
    want = riemann.AdaptiveRebias("c", "y", start, 8, "ts", ("rec",), None).apply(Trials(df, {"c": (2, 2)})).df
    got = drained(spark, streaming.adaptive_rebias(stream_of(spark, tmp_path, df, 3), "c", (2, 2), start, 8, "rec", "ts", update_rate=None), tmp_path)
    want = {r["trial_id"]: r["y"] for r in want.collect()}
    for r in got:
        np.testing.assert_allclose(r["recentred"], want[r["trial_id"]], atol=1e-9)
    assert len(got) == 8


def test_streamed_marker_windows_equal_epochs(spark, tmp_path):
    rows = signal_rows(60, ("r",))
    markers = [("r", 0.45, "go"), ("r", 0.6, "go"), ("r", 2.0, "no"), ("r", 3.3, "go"), ("r", 5.85, "go")]
    schema = "recording string, ts double, values array<double>, marker string"
    df = spark.createDataFrame([(*r, None) for r in rows] + [(a, b, None, m) for a, b, m in markers], schema)
    got = drained(spark, streaming.marker_windows(stream_of(spark, tmp_path, df, 5), 6, "go", -0.2), tmp_path)
    signal = spark.createDataFrame(rows, "recording string, ts double, values array<double>")
    wanted = spark.createDataFrame([m for m in markers if m[2] == "go"], "recording string, ts double, label string")
    want = {r["t0"]: r["data"] for r in streams.epochs(signal, wanted, 6, -0.2).collect()}
    assert {r["t0"]: r["data"] for r in got} == want and len(want) == 3  # the last marker is too near the end


def test_streamed_uncoupled_windows_take_the_latest(spark, tmp_path):
    rows = [("r", float(i), [float(i)], None) for i in range(12)]
    df = spark.createDataFrame(rows, "recording string, ts double, values array<double>, marker string")
    got = drained(spark, streaming.marker_windows(stream_of(spark, tmp_path, df, 3), 2, interval=3.0), tmp_path)
    assert [r["data"] for r in sorted(got, key=lambda r: r["t0"])] == [[2.0, 3.0], [6.0, 7.0], [10.0, 11.0]]
