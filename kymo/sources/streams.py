"""Signals and markers as tables, and how trials are cut from them.

A signal is (recording, ts, values: array<double>, one element a channel); markers are (recording, ts, marker). Times are
seconds as doubles. Recordings are independent, so everything is partitioned by them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.operators import ordered
from kymo.operators.base import Trials
from kymo.session import stored


def target_labels(markers: DataFrame, by: str = "recording", ts: str = "ts", marker: str = "marker") -> DataFrame:
    """Flashes with label ``target`` or ``non-target``: JSON markers, the last {"target": t} against each {"flash": [..]}.

    Flashes before any target are dropped. Markers with equal times are taken in the order of their text.
    """
    target = F.get_json_object(marker, "$.target")
    flash = F.from_json(F.get_json_object(marker, "$.flash"), "array<string>")
    past = Window.partitionBy(by).orderBy(ts, marker).rowsBetween(Window.unboundedPreceding, 0)
    known = markers.withColumn("_target", F.last(target, ignorenulls=True).over(past)).withColumn("_flash", flash)
    label = F.when(F.array_contains("_flash", F.col("_target")), "target").otherwise("non-target")
    return known.filter("_flash is not null and _target is not null").withColumn("label", label).drop("_target", "_flash")


def task_markers(markers: DataFrame, tasks: Sequence[str], marker: str = "marker") -> DataFrame:
    """Markers that are one of ``tasks``; label is the place in them."""
    index = F.array_position(F.lit(list(tasks)), F.col(marker)) - 1
    return markers.filter(F.col(marker).isin(list(tasks))).withColumn("label", index.cast("int"))


def matching_markers(markers: DataFrame, pattern: str, marker: str = "marker") -> DataFrame:
    """Markers that match a regular expression from their start."""
    return markers.filter(F.col(marker).rlike(f"^(?:{pattern})"))


def last_marker(markers: DataFrame, at: Column | float | None = None, pattern: str | None = None, by: str = "recording", ts: str = "ts", marker: str = "marker") -> DataFrame:
    """(recording, ts, marker): of each recording the last (matching) marker, up to and with time ``at`` where given.

    Of markers with equal times the last in the order of their text counts.
    """
    return _one_marker(markers, None if at is None else F.col(ts) <= at, pattern, by, ts, marker, F.max)


def peek_marker(markers: DataFrame, at: Column | float, pattern: str | None = None, by: str = "recording", ts: str = "ts", marker: str = "marker") -> DataFrame:
    """(recording, ts, marker): of each recording the first (matching) marker after time ``at``, without using it up."""
    return _one_marker(markers, F.col(ts) > at, pattern, by, ts, marker, F.min)


def _one_marker(markers: DataFrame, when: Column | None, pattern: str | None, by: str, ts: str, marker: str, pick: Callable[[Column], Column]) -> DataFrame:
    some = markers if pattern is None else matching_markers(markers, pattern, marker)
    some = (some if when is None else some.filter(when)).filter(F.col(ts).isNotNull())
    return some.groupBy(by).agg(pick(F.struct(ts, marker)).alias("_m")).select(by, F.col(f"_m.{ts}").alias(ts), F.col(f"_m.{marker}").alias(marker))


def epochs(signal: DataFrame, markers: DataFrame, samples: int, relative_start: float = 0.0, channels: Sequence[int] | None = None,
           by: str = "recording", ts: str = "ts", values: str = "values", keep: Sequence[str] = ("label",), split: bool = False) -> DataFrame:
    """One row a marker: the first sample at or after marker + ``relative_start`` and those after it, ``samples`` in all.

    By count, not by time: samples are numbered within their recording, a marker finds the number of its first sample in a
    merge of both streams by time (no pair of the two is made that isn't in a trial), and an equi-join on blocks
    of numbers fetches the rest. Trials that run over the end are dropped. ``data`` is row-major (channels, samples).
    A recording is sorted in one task or, with ``split``, over all tasks.
    """
    wanted = markers.withColumn("_at", F.col(ts) + F.lit(float(relative_start)))
    samples_ = signal.select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.col(values).alias("_values"))
    if split:
        # in the order of time, markers before samples of the same time: as many samples as come before a marker, that is its first sample's number
        wanted = wanted.withColumn("marker_id", F.monotonically_increasing_id())
        wanted = stored(wanted, "markers")
        slim = wanted.select(F.col(by).alias("_by"), F.col("_at").alias("_ts"), "marker_id")
        merged = slim.unionByName(samples_, allowMissingColumns=True)
        counted = ordered.earlier(merged, ["_by"], ["_ts", F.col("marker_id").isNull()], {"_n": F.col("marker_id").isNull()})
        numbered = counted.filter("marker_id is null").select("_by", "_ts", "_values", "_n")
        firsts = counted.filter("marker_id is not null and _ts is not null").select("_by", "marker_id", F.col("_n").alias("_first"))
    else:
        numbered = samples_.withColumn("_n", (F.row_number().over(Window.partitionBy("_by").orderBy("_ts")) - 1).cast("long"))
        wanted = wanted.withColumn("marker_id", F.row_number().over(Window.partitionBy(by).orderBy(ts, *keep)))
        slim = wanted.select(F.col(by).alias("_by"), F.col("_at").alias("_ts"), F.lit(None).cast("long").alias("_n"), F.col("marker_id"))
        merged = slim.unionByName(numbered.select("_by", "_ts", "_n", F.lit(None).cast("int").alias("marker_id")))
        # backwards in time, so that the frame only grows: the last sample met is the first one at or after the marker
        met = Window.partitionBy("_by").orderBy(F.desc("_ts"), F.col("_n").isNull(), F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
        firsts = merged.withColumn("_first", F.last("_n", ignorenulls=True).over(met)).filter("marker_id is not null and _first is not null").select("_by", "marker_id", "_first")
    block = max(1, samples)
    blocks = firsts.withColumn("_block", F.explode(F.sequence(F.expr(f"_first div {block}"), F.expr(f"(_first + {samples - 1}) div {block}"))))
    cut = blocks.join(numbered.withColumn("_block", F.expr(f"_n div {block}")), ["_by", "_block"]).filter(f"_n >= _first and _n < _first + {samples}")
    picked = F.col("_values") if channels is None else F.array(*[F.get("_values", F.lit(int(c))) for c in channels])
    trials = cut.groupBy("_by", "marker_id").agg(F.sort_array(F.collect_list(F.struct("_n", picked.alias("v")))).alias("_s"), F.min("_ts").alias("t0"))
    trials = trials.filter(F.size("_s") == samples)
    by_channel = F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.col("_s")[0]["v"]) - 1), lambda c: F.transform("_s", lambda s: F.get(s["v"], c))))
    info = wanted.select(F.col(by).alias("_by"), "marker_id", F.col(ts).alias("marker_ts"), *keep)
    return trials.select("_by", "marker_id", "t0", by_channel.alias("data")).join(info, ["_by", "marker_id"]).withColumnRenamed("_by", by)


def as_trials(df: DataFrame, channels: int, samples: int, by: str = "recording", label: str = "label") -> Trials:
    """Epochs as trials with a number for each, in order of recording and marker."""
    numbered = df.withColumn("trial_id", F.xxhash64(by, "marker_id"))
    return Trials(numbered, {"data": (channels, samples)}, "trial_id", label)


def nth_of_class(df: DataFrame, n: int | Column, label: str = "label", order: Sequence[str] = ("marker_ts",), by_class: bool = True) -> DataFrame:
    """The n-th trial (from 1) of each class, or of all, in ``order``."""
    window = Window.partitionBy(label if by_class else F.lit(0)).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") == n).drop("_nth")


def continuous(files: Sequence[DataFrame]) -> DataFrame:
    """Recordings one after the other: rows of all files with ``file``, their place; an order by (file, ts) is an order in time."""
    out = None
    for i, df in enumerate(files):
        part = df.withColumn("file", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def one_after_the_other(signal: DataFrame, markers: DataFrame, by: str = "recording", ts: str = "ts") -> DataFrame:
    """``signal`` with ``first_marker``, the time of its recording's first marker: an order by (first_marker, recording, ts) is that of all recordings.

    Recordings without markers are left out.
    """
    return signal.join(markers.groupBy(by).agg(F.min(ts).alias("first_marker")).filter("first_marker is not null"), by)


def count_windows(signal: DataFrame, samples: int, stride: int | None = None, by: str = "recording", ts: str = "ts", values: str = "values", split: bool = False) -> DataFrame:
    """Windows of ``samples`` successive samples every ``stride`` (default: side by side) of each recording; the rest at the end is dropped.

    A recording is sorted in one task or, with ``split``, over all tasks.
    """
    stride = stride or samples
    if split:
        numbered = ordered.earlier(signal.select(by, ts, values), [by], [ts], {"_n": F.lit(True)})
    else:
        numbered = signal.withColumn("_n", (F.row_number().over(Window.partitionBy(by).orderBy(ts)) - 1).cast("long"))
    last = F.expr(f"_n div {stride}")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_n") - (samples - 1)) / stride))
    spread = numbered.withColumn("_w", F.explode(F.when(first <= last, F.sequence(first, last))))
    grouped = spread.groupBy(by, F.col("_w").alias("window")).agg(F.sort_array(F.collect_list(F.struct("_n", values))).alias("_s"), F.min(ts).alias("t0"))
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.col("_s")[0][values]) - 1), lambda c: F.transform("_s", lambda s: F.get(s[values], c))))
    return grouped.filter(F.size("_s") == samples).select(by, "window", "t0", data.alias("data"))


def marker_json(**fields: object) -> str:
    """The text of a JSON marker, such as marker_json(flash=[3])."""
    return json.dumps(fields)
