"""Operators on streams of trials, samples and markers, with bounded state for each recording.

Operators that look at one trial only run on streams as they are. Those that remember keep their memory in Spark's state
store (``transformWithState`` on RocksDB), keyed by recording, as arrays: a buffer is a list that is appended to, samples that trials may need
lie in buckets of time, many on a page. A micro-batch writes what is new and reads what its results need; it doesn't rewrite the rest.

When is a row too late? Without ``late_seconds``, trials of one micro-batch are taken in order, and a trial that comes after later ones were
processed is dropped, as nothing can be re-ordered across batches. With ``late_seconds``, times are event times with a watermark that many seconds
behind the latest time of all recordings, which must share a clock: rows wait in the state until the watermark has passed them and
are then taken in order, so results equal those of the batch operators whatever the order of arrival; only rows that come behind the watermark
of the micro-batch before are dropped (Spark counts them). Trials of equal times are all kept, in the order in which they come. The batch operators of the same names give equal
results; like theirs, those of tied trials depend on that order.

With ``expire_seconds``, a recording from which nothing has come for so long is forgotten (in event time where there is a watermark, else by
the clock); if it speaks again, it begins anew.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from kymo.numerics import spd
from kymo.operators.base import Shape
from kymo.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of the event time while a stream is grouped.
AT = "_event_time_"


#: Seconds that event times are put forward: a watermark begins at the epoch, and what isn't behind that would be late from the first.
FORWARD = 1_000_000_000


def _micros(seconds: pd.Series) -> np.ndarray:
    """Event times."""
    return np.floor(seconds.to_numpy(float) * 1e6).astype(np.int64) + FORWARD * 1_000_000


class Recording(StatefulProcessor):
    """What all operators share: order, rows that wait for the watermark, and expiry. ``take`` has the rest."""

    def __init__(self, order: str, late: float | None, expire: float | None):
        self.order, self.late, self.expire = order, late, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last double, wake long, release long")
        self.waiting = handle.getListState("waiting", "rows binary") if self.late is not None else None
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """Open this operator's own state."""
        raise NotImplementedError

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Results for rows in order."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clear this operator's own state."""
        raise NotImplementedError

    def drops_old(self) -> bool:
        """Whether rows before the last one that was taken are dropped."""
        return True

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = list(rows)
        new = some[0] if len(some) == 1 else pd.concat(some)
        last, wake, release = self.clock.get() or (-math.inf, 0, 0)
        if self.late is None:
            new = new.sort_values(self.order, kind="stable")
            if self.drops_old():
                new = new[new[self.order] >= last]
            if len(new):
                last = max(last, float(new[self.order].iloc[-1]))
                wake = self._wake(wake, timerValues.getCurrentProcessingTimeInMs() if self.expire is not None else 0)
                self.clock.update((last, wake, 0))
                out = self.take(key, new)
                if out is not None and len(out):
                    yield out
            return
        new = new[self.columns]
        table = pa.Table.from_pandas(new, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.waiting.appendValue((sink.getvalue().to_pybytes(),))
        # the timer of an instant fires once the watermark has reached it
        first = int(-(-_micros(new[self.order]).min() // 1000))
        if not release or first < release:
            if release:
                self.handle.deleteTimer(release)
            self.handle.registerTimer(first)
            release = first
        self.clock.update((last, wake, release))
        yield from ()

    def _wake(self, wake: int, now: float) -> int:
        """Move the timer of expiry; milliseconds."""
        if self.expire is None:
            return 0
        if wake:
            self.handle.deleteTimer(wake)
        wake = int(now + self.expire * 1000)
        self.handle.registerTimer(wake)
        return wake

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.clock.get()
        if found is None:
            return
        last, wake, release = found
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if self.late is not None and fired == release:
            every = pd.concat([pa.ipc.open_stream(pa.py_buffer(bytes(r[0]))).read_all().to_pandas() for r in self.waiting.get()]).sort_values(self.order, kind="stable")
            due = _micros(every[self.order]) <= timerValues.getCurrentWatermarkInMs() * 1000
            rest, every = every[~due], every[due]
            release = 0
            if len(rest):
                sink = pa.BufferOutputStream()
                table = pa.Table.from_pandas(rest, preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                self.waiting.put([(sink.getvalue().to_pybytes(),)])
                release = int(-(-_micros(rest[self.order]).min() // 1000))
                self.handle.registerTimer(release)
            else:
                self.waiting.clear()
            if len(every):
                last = float(every[self.order].iloc[-1])
                wake = self._wake(wake, (last + FORWARD) * 1000)
                self.clock.update((last, wake, release))
                out = self.take(key, every)
                if out is not None and len(out):
                    yield out
            else:
                self.clock.update((last, wake, release))
        elif fired == wake:
            if release:  # rows are waiting: the recording isn't silent
                self.clock.update((last, self._wake(0, fired), release))
            else:
                self.clock.clear()
                self.forget()

    def close(self) -> None:
        pass


def _run(df: DataFrame, by: str, processor: Recording, schema: StructType | str) -> DataFrame:
    """The processor on a stream, with event time where it waits for a watermark."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    mode = "None" if processor.expire is None else "ProcessingTime"
    processor.columns = df.columns
    if processor.late is not None:
        df = df.filter(F.col(processor.order).isNotNull()).withColumn(AT, F.timestamp_micros(F.floor(F.col(processor.order) * 1e6).cast("long") + FORWARD * 1_000_000)).withWatermark(AT, f"{int(processor.late * 1e6)} microseconds")
        mode = "EventTime"
    return df.groupBy(by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=mode)


def _added(df: DataFrame, output: str, kind: str) -> StructType:
    return StructType([*df.schema.fields, StructField(output, _parse_datatype_string(kind))])


def _stacked(column: pd.Series) -> np.ndarray:
    """The arrays of a column, one a row."""
    return np.stack([np.asarray(x, float) for x in column])


class Buffered(Recording):
    """Operators whose memory is the last ``capacity`` tensors: a list that is appended to and cut when it has doubled."""

    def __init__(self, order: str, late: float | None, expire: float | None, column: str, capacity: int, output: str, names: list[str], flag: str | None, results: Callable):
        super().__init__(order, late, expire)
        self.column, self.capacity, self.output, self.names, self.flag, self.results = column, capacity, output, names, flag, results

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "x array<double>")

    def forget(self) -> None:
        self.held.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        listed = [r[0] for r in self.held.get()] if self.held.exists() else []
        pushes = np.ones(len(rows), bool) if self.flag is None else rows[self.flag].fillna(False).to_numpy().astype(bool)
        old = listed[-self.capacity :] if self.capacity else []
        new = [np.asarray(x, float) for x in rows[self.column][pushes]]
        every = np.stack([*(np.asarray(x, float) for x in old), *new]) if old or new else np.empty((0, 0))
        results = self.results(every, len(old) + np.cumsum(pushes))
        kept = [(x.tolist(),) for x in new[-self.capacity :]] if self.capacity else []
        if len(listed) + len(kept) > 2 * self.capacity:
            self.held.put([(x.tolist(),) for x in every[-self.capacity :]] if self.capacity else [])
        elif kept:
            self.held.appendList(kept)
        return rows.assign(**{self.output: results})[self.names]


def ring_buffer(df: DataFrame, column: str, capacity: int, by: str, order: str, output: str = "buffer", flag: str | None = None, late_seconds: float | None = None,
                expire_seconds: float | None = None) -> DataFrame:
    """What the last ``capacity`` pushed tensors are at each trial, oldest first; with ``flag`` only flagged trials push."""
    schema = _added(df, output, "array<array<double>>")

    def results(every: np.ndarray, upto: np.ndarray) -> list:
        return [every[max(0, n - capacity) : n].tolist() for n in upto]

    return _run(df, by, Buffered(order, late_seconds, expire_seconds, column, capacity, output, schema.fieldNames(), flag, results), schema)


def running_average(df: DataFrame, column: str, length: int, by: str, order: str, output: str = "average", late_seconds: float | None = None, expire_seconds: float | None = None) -> DataFrame:
    """Mean of the last ``length`` tensors, the current one included."""
    schema = _added(df, output, "array<double>")

    def results(every: np.ndarray, upto: np.ndarray) -> list:
        before = int(upto[0]) - 1
        few = [every[:n].mean(axis=0) for n in range(before + 1, min(length, len(every) + 1))]
        whole = np.lib.stride_tricks.sliding_window_view(every, length, axis=0).mean(axis=-1)[max(0, before + 1 - length) :] if len(every) >= length else []
        return [x.tolist() for x in [*few, *whole]]

    return _run(df, by, Buffered(order, late_seconds, expire_seconds, column, length - 1, output, schema.fieldNames(), None, results), schema)


class Following(Recording):
    """Matrices about a bias that follows them."""

    def __init__(self, order: str, late: float | None, expire: float | None, column: str, shape: Shape, bias: np.ndarray, seen: int, rate: float | None, output: str, names: list[str]):
        super().__init__(order, late, expire)
        self.column, self.shape, self.bias, self.seen, self.rate, self.output, self.names = column, shape, np.asarray(bias, float), seen, rate, output, names

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "bias array<double>, seen long")

    def forget(self) -> None:
        self.held.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = self.held.get()
        b, n = (np.array(found[0], float).reshape(self.shape), found[1]) if found else (self.bias, self.seen)
        out = []
        for x in rows[self.column]:  # each depends on the one before
            x, w = np.asarray(x, float).reshape(self.shape), spd.invsqrtm(b)
            out.append((w @ x @ w).ravel().tolist())
            b, n = spd.geodesic(b, x, 1 / (n + 1) if self.rate is None else self.rate), n + 1
        self.held.update((b.ravel().tolist(), int(n)))
        return rows.assign(**{self.output: out})[self.names]


def adaptive_rebias(df: DataFrame, column: str, shape: Shape, bias: np.ndarray, seen: int, by: str, order: str, output: str = "recentred", update_rate: float | None = 0.1,
                    late_seconds: float | None = None, expire_seconds: float | None = None) -> DataFrame:
    """Matrices about a bias that follows them along geodesics."""
    schema = _added(df, output, "array<double>")
    return _run(df, by, Following(order, late_seconds, expire_seconds, column, shape, bias, seen, update_rate, output, schema.fieldNames()), schema)


WINDOWS = "recording string, marker string, t0 double, data array<double>"


#: Samples of a page of buckets.
PAGE = 256


class Samples:
    """Samples in buckets of time. ``ids`` and ``counts`` list the buckets; ``pages`` has for each the key under which a map state holds
    it, with others that came at the same time. Pages that a call touches are read once, and ``save`` writes once what has changed and is kept."""

    def __init__(self, state, seconds: float, ids: list[int], counts: list[int], pages: list[int]):
        self.state, self.seconds = state, seconds
        self.counts = dict(zip(ids, counts))
        self.pages = dict(zip(ids, pages))
        self.stored = set(pages)
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.changed: set[int] = set()

    def _split(self, times: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, times, values) of samples in order of time."""
        ids, firsts = np.unique(np.floor(times / self.seconds).astype(np.int64), return_index=True)
        for i, at, end in zip(ids.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(times)]):
            yield i, times[at:end], values[at:end]

    def bucket(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(times, values) of a bucket, in order of time."""
        if i not in self.read:
            times, flat = self.state.getValue((self.pages[i],))
            times = np.array(times, float)
            for k, t, v in self._split(times, np.array(flat, float).reshape(len(times), -1)):
                if self.pages.get(k) == self.pages[i] and k not in self.read:
                    self.read[k] = t, v
        return self.read[i]

    def add(self, times: np.ndarray, values: np.ndarray) -> None:
        """New samples, in order of time."""
        for i, t, v in self._split(times, values):
            if i in self.counts:
                old = self.bucket(i)
                t, v = np.concatenate([old[0], t]), np.concatenate([old[1], v])
                order = np.argsort(t, kind="stable")
                t, v = t[order], v[order]
            self.read[i], self.counts[i] = (t, v), len(t)
            self.changed.add(i)

    def save(self) -> tuple[list[int], list[int], list[int]]:
        """Write what has changed; (ids, counts, pages)."""
        page, held, next_ = None, 0, max(self.stored, default=-1) + 1
        for i in sorted(self.changed - self.pages.keys()):
            if page is None or held + self.counts[i] > PAGE:
                page, held, next_ = next_, 0, next_ + 1
            self.pages[i] = page
            held += self.counts[i]
        written, used = {self.pages[i] for i in self.changed}, set(self.pages.values())
        together: dict[int, list[int]] = {p: [] for p in written}
        for i in sorted(self.counts):
            if self.pages[i] in written:
                together[self.pages[i]].append(i)
        for p, own in together.items():
            some = [self.bucket(i) for i in own]
            self.state.updateValue((p,), (np.concatenate([t for t, _ in some]).tolist(), np.concatenate([v for _, v in some]).ravel().tolist()))
        for p in self.stored - used:
            self.state.removeKey((p,))
        self.stored, self.changed, ids = used, set(), sorted(self.counts)
        return ids, [self.counts[i] for i in ids], [self.pages[i] for i in ids]

    def _from(self, start: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = -math.inf if start == -math.inf else math.floor(start / self.seconds)
        for i in sorted(k for k in self.counts if k >= first):
            t, v = self.bucket(i)
            n = int(np.searchsorted(t, start, "left")) if i == first else 0
            yield t[n:], v[n:]

    def count(self, start: float) -> int:
        """Samples at or after a time; only the first bucket is read."""
        first = -math.inf if start == -math.inf else math.floor(start / self.seconds)
        own = len(self.bucket(first)[0]) - int(np.searchsorted(self.bucket(first)[0], start, "left")) if first in self.counts else 0
        return own + sum(n for i, n in self.counts.items() if i > first)

    def first(self, start: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` samples at or after a time."""
        times, values, have = [], [], 0
        for t, v in self._from(start):
            times.append(t)
            values.append(v)
            have += len(t)
            if have >= n:
                break
        return np.concatenate(times)[:n], np.concatenate(values)[:n]

    def latest(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The last ``n`` samples."""
        times, values, have = [], [], 0
        for i in sorted(self.counts, reverse=True):
            t, v = self.bucket(i)
            times.insert(0, t)
            values.insert(0, v)
            have += len(t)
            if have >= n:
                break
        return np.concatenate(times)[-n:], np.concatenate(values)[-n:]

    def drop_before(self, time: float) -> float:
        """Forget buckets that end by a time; the time of the last sample that was forgotten, or minus infinity."""
        gone = [i for i in self.counts if (i + 1) * self.seconds <= time]
        last = float(self.bucket(max(gone))[0][-1]) if gone else -math.inf
        for i in gone:
            del self.counts[i]
            self.pages.pop(i, None)
            self.read.pop(i, None)
            self.changed.discard(i)
        return last

    def newest(self) -> float:
        return float(self.bucket(max(self.counts))[0][-1]) if self.counts else -math.inf


class Windows(Recording):
    """Trials from samples and markers of a recording."""

    def __init__(self, late: float | None, expire: float | None, samples: int, pattern: str | None, relative_start: float, interval: float | None, keep: float, channels: list[int] | None, bucket: float):
        super().__init__("ts", late, expire)
        self.samples, self.pattern, self.relative_start, self.interval, self.keep, self.channels, self.bucket = samples, pattern, relative_start, interval, keep, channels, bucket

    def drops_old(self) -> bool:
        return False  # samples and markers may come late as long as what is kept has them

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", "page long", "times array<double>, flat array<double>")
        self.held = handle.getValueState("held", "starts array<double>, markers array<string>, begin double, forgotten double, ids array<long>, counts array<long>, pages array<long>")

    def forget(self) -> None:
        self.buckets.clear()
        self.held.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        starts, markers, begin, forgotten, ids, counts, pages = self.held.get() or ([], [], -math.inf, -math.inf, [], [], [])
        store = Samples(self.buckets, self.bucket, ids, counts, pages)
        new = rows[rows["values"].notna() & (rows["ts"] > forgotten)]
        if len(new):
            values = _stacked(new["values"])
            store.add(new["ts"].to_numpy(float), values if self.channels is None else values[:, self.channels])
        out = []

        def cut(times: np.ndarray, values: np.ndarray, marker: str | None) -> None:
            out.append((key[0], marker, float(times[0]), values.T.ravel().tolist()))

        if self.pattern is not None:
            match = re.compile(self.pattern).match
            said = rows[rows["marker"].notna()]
            waiting = sorted([*zip(starts, markers), *((float(t) + self.relative_start, m) for t, m in zip(said["ts"], said["marker"]) if match(m))])
            still = []
            for start, marker in waiting:
                if start <= forgotten:
                    out.append((key[0], marker, None, None))
                elif store.count(start) >= self.samples:
                    cut(*store.first(start, self.samples), marker)
                else:
                    still.append((start, marker))
            starts, markers = [s for s, _ in still], [m for _, m in still]
            # behind a watermark no marker comes any more; without one, late markers find what is kept
            reach = float(rows["ts"].iloc[-1]) + min(0.0, self.relative_start) if self.late is not None else store.newest() - self.keep
            needed = min([reach, *starts])
        else:
            if store.count(begin) >= self.samples:
                times, values = store.latest(self.samples)
                cut(times, values, None)
                begin = float(times[0] + self.interval) if self.interval is not None else float(np.nextafter(times[-1], np.inf))
            needed = begin
        forgotten = max(forgotten, store.drop_before(needed))
        self.held.update((starts, markers, begin, forgotten, *store.save()))
        return pd.DataFrame(out, columns=["recording", "marker", "t0", "data"]) if out else None


def marker_windows(events: DataFrame, samples: int, pattern: str | None = None, relative_start: float = 0.0, interval: float | None = None, keep_seconds: float = 60.0,
                   channels: list[int] | None = None, late_seconds: float | None = None, expire_seconds: float | None = None, bucket_seconds: float = 1.0) -> DataFrame:
    """Trials from a stream of samples and markers (recording, ts, values, marker; one of values and marker is null).

    Coupled to markers (``pattern``, from the start of the text): a trial is the first ``samples`` samples at or after
    marker + ``relative_start``, given as soon as they are there; trials may overlap. Without ``pattern``: a trial of ``samples``
    samples from ``interval`` seconds after the one before (None: from the next sample); where a backlog holds several, the
    latest is given and the others are skipped.

    What is held are the samples that an open trial may need and, with ``late_seconds``, those behind the watermark: rows are taken in order of time
    once it has passed them. Without, rows are taken as they come and samples of the last ``keep_seconds`` are held, in case a
    marker comes late; a marker that comes so late that samples at or after its start have been forgotten gives a row
    without t0 and data, and samples that come when later ones have been forgotten are dropped. Samples are held and forgotten
    in buckets of ``bucket_seconds``.
    """
    return _run(events.filter("ts is not null"), "recording", Windows(late_seconds, expire_seconds, samples, pattern, relative_start, interval, keep_seconds, channels, bucket_seconds), WINDOWS)


def to_sink(df: DataFrame, push: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> DataStreamWriter:
    """A writer that hands every micro-batch to ``push``; with ``once`` it stops when what is there has been read."""
    writer = df.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer
