"""Trials of equal times in streams: none is lost, within a micro-batch or across two."""

from kymo.operators import shape
from kymo.operators.base import Trials
from kymo.streaming import operators as streaming

from .test_sources import drained, stream_of


def test_tied_trials_are_kept(spark, tmp_path):
    # three trials at each time; micro-batches of four and five rows cut ties apart
    rows = [(i, "a", float(i // 3), [float(i // 3), 1.0]) for i in range(14)]
    df = spark.createDataFrame(rows, "trial_id long, rec string, ts double, x array<double>")
    stream = stream_of(spark, tmp_path, df, 3)
    (tmp_path / "1").mkdir()
    got = {r["trial_id"]: r["y"] for r in drained(spark, streaming.running_average(stream, "x", 3, "rec", "ts", "y"), tmp_path / "1")}
    batch = shape.RunningAverage("x", "y", 3, "ts", ("rec",)).apply(Trials(df, {"x": (2,)})).df.collect()
    # tied trials hold equal values, so the averages of a time don't depend on their order
    assert set(got) == set(range(14))
    assert sorted((rows[i][2], *y) for i, y in got.items()) == sorted((r["ts"], *r["y"]) for r in batch)
