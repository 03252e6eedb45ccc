"""Live streams: files and messages in and out, late sources, silence, late markers, and long recordings."""

import json
import threading
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kymo.sources import streams
from kymo.streaming import live
from kymo.streaming import operators as streaming

from .test_sources import drained, stream_of


def lines(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)))


def test_folders_in_and_out(spark, tmp_path):
    lines(tmp_path / "s" / "1.json", [{"recording": "r", "ts": float(i), "values": [i, -i]} for i in range(10)])
    lines(tmp_path / "m" / "1.json", [{"recording": "r", "ts": 2.0, "marker": "go"}, {"recording": "r", "ts": 4.5, "marker": "no"}])
    events = live.events(live.from_folder(spark, str(tmp_path / "s")), live.from_folder(spark, str(tmp_path / "m"), live.MARKERS))
    windows = streaming.marker_windows(events, 3, "go", channels=[1])
    live.to_folder(windows, str(tmp_path / "out"), str(tmp_path / "state"), once=True).start().awaitTermination()
    got = spark.read.schema(streaming.WINDOWS).json(str(tmp_path / "out")).collect()
    assert [tuple(r) for r in got] == [("r", "go", 2.0, [-2.0, -3.0, -4.0])]


def test_messages(spark):
    df = spark.createDataFrame([("r", 1.5, [1.0, 2.0])], live.SAMPLES)
    sent = live.messages(df)
    assert sent.columns == ["key", "value"] and live.parsed(sent.withColumn("value", F.col("value").cast("binary"))).collect() == df.collect()
    assert live.parsed(spark.createDataFrame([("broken",), ('{"ts": 1}',)], "value string")).count() == 0


def test_a_source_that_comes_late(spark, tmp_path):
    path = tmp_path / "later"
    with pytest.raises(AnalysisException):
        live.opened(lambda: spark.read.json(str(path)), 0.2, 0.05)
    threading.Timer(0.6, lambda: lines(path / "a.json", [{"ts": 1}])).start()
    assert live.opened(lambda: spark.read.json(str(path)), 20, 0.1).count() == 1


def test_silence_is_an_error(spark, tmp_path):
    lines(tmp_path / "s" / "1.json", [{"recording": "r", "ts": 1.0, "values": [1]}])
    query = live.from_folder(spark, str(tmp_path / "s")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    began = time.monotonic()
    with pytest.raises(live.StalledError):
        live.watch(query, 2.0)
    assert not query.isActive and time.monotonic() - began < 60
    query = live.from_folder(spark, str(tmp_path / "s")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    live.watch(query, 60.0)
    assert query.lastProgress["numInputRows"] == 1


def test_late_markers(spark, tmp_path):
    """Samples 0 to 29 in three micro-batches; a marker that comes with the last one finds its samples only if they are kept."""
    rows = [("r", float(i), [float(i)], None) for i in range(30)] + [("r", 100.0, None, "end")]
    df = spark.createDataFrame(rows, "recording string, ts double, values array<double>, marker string")
    late = F.when(F.col("marker").isNotNull(), 3.0).otherwise(F.col("ts"))
    for folder, keep, want in (("a", 60.0, [("end", 3.0, [3.0, 4.0])]), ("b", 5.0, [("end", None, None)])):
        (tmp_path / folder).mkdir()
        stream = stream_of(spark, tmp_path / folder, df, 3).withColumn("ts", late)
        assert [tuple(r)[1:] for r in drained(spark, streaming.marker_windows(stream, 2, "end", keep_seconds=keep), tmp_path / folder)] == want


def test_markers_before_and_after(spark):
    df = spark.createDataFrame([("a", 1.0, "go"), ("a", 2.0, "no"), ("a", 3.0, "go"), ("b", 5.0, "no"), ("b", None, "go")], live.MARKERS)
    found = lambda out: sorted(map(tuple, out.collect()))
    assert found(streams.last_marker(df)) == [("a", 3.0, "go"), ("b", 5.0, "no")]
    assert found(streams.last_marker(df, 2.5, "go")) == [("a", 1.0, "go")]
    assert found(streams.peek_marker(df, 1.0)) == [("a", 2.0, "no"), ("b", 5.0, "no")]
    assert found(streams.peek_marker(df, 1.0, "go")) == [("a", 3.0, "go")]


def test_long_recordings(spark):
    """A million samples of one recording: time grows with their number, not its square."""
    signal = spark.range(1_000_000).select(F.lit("r").alias("recording"), (F.col("id") / 250).alias("ts"), F.array(F.col("id").cast("double")).alias("values"))
    markers = spark.range(2000).select(F.lit("r").alias("recording"), (F.col("id") * 2 + 0.001).alias("ts"), F.col("id").alias("label"))
    began = time.perf_counter()
    got = streams.epochs(signal, markers, 50, 0.1).select("label", "data").collect()
    assert time.perf_counter() - began < 60
    assert len(got) == 2000
    for r in got[::97]:
        first = int(np.ceil((r["label"] * 2 + 0.101) * 250 - 1e-9))
        assert r["data"] == [float(first + i) for i in range(50)]
