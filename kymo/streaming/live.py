"""Live streams of samples, markers and trials: where they come from, where they go, and whether they are alive.

A sample is (recording, ts, values), a marker (recording, ts, marker). Streams come as files that something drops in a folder
or as messages of a Kafka topic, each a JSON object with these names; both are joined to one stream of events for
``marker_windows``. A stream that isn't there yet is waited for, one that falls silent raises an error.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

SAMPLES = "recording string, ts double, values array<double>"
MARKERS = "recording string, ts double, marker string"


class StalledError(RuntimeError):
    """A stream hasn't delivered anything for longer than it may."""


def from_folder(spark: SparkSession, path: str, schema: str = SAMPLES, files: str = "json", per_trigger: int | None = None) -> DataFrame:
    """Rows of files (json, parquet or csv) that come into a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).format(files).load(path)


def from_topic(spark: SparkSession, servers: str, topic: str, schema: str = SAMPLES, start: str = "latest") -> DataFrame:
    """Rows of a Kafka topic of JSON objects; needs Spark's Kafka connector on the class path. What doesn't parse is dropped."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()
    return parsed(raw, schema)


def parsed(messages: DataFrame, schema: str = SAMPLES) -> DataFrame:
    """The objects in ``value`` (JSON as bytes or text) as rows of a schema, without those that lack a recording or time."""
    rows = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    return rows.filter("recording is not null and ts is not null")


def events(samples: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """One stream of samples and markers, as ``marker_windows`` takes it; without markers for trials that aren't coupled to any."""
    out = samples.select("recording", "ts", "values", F.lit(None).cast("string").alias("marker"))
    if markers is None:
        return out
    return out.unionByName(markers.select("recording", "ts", F.lit(None).cast("array<double>").alias("values"), "marker"))


def messages(df: DataFrame, key: str = "recording") -> DataFrame:
    """Rows as (key, value) with a JSON object of all columns, as topics take them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def to_folder(df: DataFrame, path: str, checkpoint: str, files: str = "json", once: bool = False) -> DataStreamWriter:
    """A writer of rows to files in a folder, each row exactly once."""
    writer = df.writeStream.format(files).option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer


def to_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "recording") -> DataStreamWriter:
    """A writer of rows to a Kafka topic, each at least once; needs Spark's Kafka connector on the class path."""
    return messages(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def opened(open_: Callable[[], DataFrame], seconds: float = 60.0, every: float = 0.5) -> DataFrame:
    """What ``open_`` gives, tried again until the source is there; its own error after ``seconds``."""
    end = time.monotonic() + seconds
    while True:
        try:
            return open_()
        except Exception:  # a source that isn't there fails in ways of its own
            if time.monotonic() >= end:
                raise
        time.sleep(every)


def watch(query: StreamingQuery, stall_seconds: float = 1.0, until: Callable[[], bool] = lambda: False, every: float = 0.05) -> None:
    """Return when the query ends or ``until`` holds; where it reads no row for ``stall_seconds``, stop it and raise ``StalledError``.

    A micro-batch that is being worked on isn't silence.
    """
    seen, heard = None, time.monotonic()
    while query.isActive and not until():
        progress = query.lastProgress
        if progress is not None and progress["batchId"] != seen and progress["numInputRows"]:
            seen, heard = progress["batchId"], time.monotonic()
        if query.status["isTriggerActive"] and query.status["isDataAvailable"]:
            heard = time.monotonic()
        if time.monotonic() - heard > stall_seconds:
            query.stop()
            raise StalledError(f"the stream hasn't delivered anything for {stall_seconds} s")
        time.sleep(every)
    if query.exception() is not None:
        raise query.exception()
