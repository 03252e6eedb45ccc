"""XDF recordings as a data source of Spark: tables and streams, read and written.

``spark.read.format("xdf")``: files split over tasks by bytes. The driver only lists files; a task that has a part of a file reads
the heads of its chunks and decodes what begins in its part. Of a schema given by the user only those columns are made, and the
reader itself filters by the options ``recordings``, ``streams``, ``names``, ``types`` (lists with commas between), ``from`` and
``until`` (times; from the first on and before the second) and picks ``channels`` (labels or numbers); ``reader`` takes them as arguments. They aren't derived from a frame's
filters: Spark (4.1) keeps one reader for a relation, so where a frame is used twice in a plan, the filters of one use would
hold for both. Further options: ``splitBytes``, ``extension``.

``spark.readStream.format("xdf")``: recordings that are being written. An offset holds for each file the place behind its last whole
chunk and, for each stream, its last stamp and the running sums of its clock offsets, so a batch reads what is new and nothing else,
and a restart resumes there. Times are corrected by the line through the offsets measured up to the batch's end.
Option: ``maxBytesPerTrigger`` (for each file).

``df.write.format("xdf")`` and ``df.writeStream.format("xdf")``: recordings in a folder, in two phases. Tasks write whole files
under names of their own; the driver then lists them in one small file of ``_committed``, written at once. Readers take the listed
files only, so a batch that was killed before that leaves nothing, and one that was committed and is run again isn't
listed again. Options: ``name``, ``type``, ``rate``, ``labels`` of streams whose rows lack these, ``chunkSamples``.

Push rules of rows: all samples of a stream have as many channels as its first; where values are nested (a tensor whose first
axis is not the channels'), the first one is pushed; another number of channels is an error that names both. A null time is the
time of writing. Rows without values and marker aren't samples and are left out.
"""

from __future__ import annotations

import hashlib
import math
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrameReader, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import DataStreamReader

from kymo.session import ship_package
from kymo.sources import files, xdf

COMMITTED = "_committed"
SPLIT_BYTES = 64 << 20
#: Parts that a file is cut into at most: each reads the heads of all its chunks.
MOST_PARTS = 64
OPEN_COST = 1 << 20
CHUNK_SAMPLES = 4096
BOUNDARY_BYTES = 4 << 20
MOST_OPEN = 64
#: Rows and bytes of small batches that go to Spark together.
TOGETHER, TOGETHER_BYTES = 10_000, 4 << 20


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of short recordings as few larger ones."""
    some, rows, size = [], 0, 0
    for b in batches:
        if some and (rows + b.num_rows > TOGETHER or size + b.nbytes > TOGETHER_BYTES):
            yield pa.concat_batches(some)
            some, rows, size = [], 0, 0
        some.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
    if some:
        yield pa.concat_batches(some)


def _listed(path: str, extension: str) -> list[tuple[str, int]]:
    """Files of a folder; where it has a list of committed ones, only these."""
    if not files.exists(f"{path}/{COMMITTED}"):
        return files.listed(path, extension)
    logs = {p.rsplit("/", 1)[1]: files.get_json(p) for p, _ in files.listed(f"{path}/{COMMITTED}", ".json")}
    replaced = {name for log in logs.values() for name in log["replaces"]}
    return sorted((f"{path}/{name}", size) for own, log in logs.items() if own not in replaced for name, size in log["files"])


def recording_of(path: str) -> str:
    """The recording of a file: what its folder says, as ``recording=...``, or its path."""
    for part in path.split("/"):
        if part.startswith("recording="):
            return urllib.parse.unquote(part.removeprefix("recording="))
    return path


@dataclass
class Part(InputPartition):
    """Some files, whole or from a place to another."""

    some: list[tuple[str, int, int, int]]


class XdfReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.extension = options["path"], options.get("extension", ".xdf")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        some = {c: options[c].split(",") for c in ("channels", "recordings", "streams", "names", "types") if options.get(c) is not None}
        self.channels = some.pop("channels", None)
        self.wanted = {c.removesuffix("s"): set(values) for c, values in some.items()}
        self.low, self.high = (float(options[c]) if options.get(c) is not None else None for c in ("from", "until"))
        self.columns = [f.name for f in schema.fields]
        if unknown := set(self.columns) - set(xdf.COLUMNS):
            raise ValueError(f"a recording has no columns {sorted(unknown)}")

    def partitions(self):
        parts, packed, held = [], [], 0
        for path, size in _listed(self.path, self.extension):
            if not self._wanted("recording", recording_of(path)):
                continue
            step = max(self.split, -(-size // MOST_PARTS))
            if size > step:
                parts += [Part([(path, size, at, min(size, at + step))]) for at in range(0, size, step)]
                continue
            if packed and held + size + OPEN_COST > self.split:
                parts.append(Part(packed))
                packed, held = [], 0
            packed.append((path, size, 0, size))
            held += size + OPEN_COST
        return parts + [Part(packed)] * bool(packed) or [Part([])]

    def _wanted(self, column: str, value: object) -> bool:
        return column not in self.wanted or str(value) in self.wanted[column]

    def _keep(self, times):
        return (times >= (-math.inf if self.low is None else self.low)) & (times < (math.inf if self.high is None else self.high))

    def rows(self, index: xdf.Index, path: str, low: int, high: int) -> Iterator[pa.RecordBatch]:
        wanted = [s.id for s in index.streams.values() if self._wanted("stream", s.id) and self._wanted("name", s.name) and self._wanted("type", s.type)]
        return xdf.batches(index, recording_of(path), self.columns, low, high, wanted, self.channels, None if self.low is None and self.high is None else self._keep)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _together(self._read(partition))

    def _read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for path, size, low, high in partition.some:
            with files.opened(path) as file:
                yield from self.rows(xdf.Index(file, size), path, low, high)


@dataclass
class NewPart(InputPartition):
    """What a file got between two places, and what was known at the first and (of clocks) at the second."""

    path: str
    low: int
    high: int
    headers: dict
    last: dict
    clocks: dict


class XdfStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.plain = XdfReader(options, schema)
        self.most = int(options["maxbytespertrigger"]) if options.get("maxbytespertrigger") else None
        self.reached: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        for path, size in _listed(self.plain.path, self.plain.extension):
            if not self.plain._wanted("recording", recording_of(path)):
                continue
            known = self.reached.get(path, {"at": 0, "streams": {}})
            if size <= known["at"]:
                continue
            streams = {int(k): v for k, v in known["streams"].items()}
            with files.opened(path) as file:
                index = xdf.Index(file, size, known["at"], True, {k: tuple(s["header"]) for k, s in streams.items()}, {k: xdf.Clock(**s["clock"]) for k, s in streams.items()},
                                  {k: s["last"] for k, s in streams.items() if s["last"] is not None}, self.most)
                last = index.newest_stamps()
                if index.stop > known["at"]:
                    self.reached[path] = {"at": index.stop, "streams": {str(k): {"header": list(index.headers[k]), "last": last.get(k), "clock": asdict(index.clocks[k])} for k in index.streams}}
        return {"files": dict(sorted(self.reached.items()))}

    def partitions(self, start: dict, end: dict) -> list[NewPart]:
        out = []
        for path, now in end["files"].items():
            self.reached.setdefault(path, now)  # after a restart: go on from the last offset that was planned
            before = start["files"].get(path, {"at": 0, "streams": {}})
            if now["at"] > before["at"]:
                streams = now["streams"].items()
                out.append(NewPart(path, before["at"], now["at"], {int(k): tuple(s["header"]) for k, s in streams}, {int(k): s["last"] for k, s in before["streams"].items() if s["last"] is not None},
                                   {int(k): s["clock"] for k, s in streams}))
        return out

    def read(self, partition: NewPart) -> Iterator[pa.RecordBatch]:
        p = partition
        with files.opened(p.path) as file:
            index = xdf.Index(file, p.high, p.low, False, p.headers, None, p.last)
            index.clocks = {k: xdf.Clock(**c) for k, c in p.clocks.items()}
            yield from self.plain.rows(index, p.path, p.low, p.high)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: names in the folder, and bytes."""

    names: list[tuple[str, int]]


class _File:
    """A recording's file that is being written: samples gather to chunks, boundaries lie between some."""

    def __init__(self, folder: str, recording: str | None, chunk_samples: int):
        self.name = f"recording={urllib.parse.quote(str(recording), safe='')}/{uuid.uuid4().hex}.xdf"
        self.path, self.chunk_samples = f"{folder}/{self.name}", chunk_samples
        self.out = files.created(self.path)
        self.size = self.since = 0
        self.streams: dict[object, xdf.Stream] = {}
        self.counts: dict[int, list] = {}
        self.put(xdf.file_head())

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.since += len(data)

    def push(self, key: object, make, stamp: float, values: list) -> None:
        s = self.streams.get(key)
        if s is None:
            s = self.streams[key] = make(len(values))
            if s.id in self.counts:
                raise ValueError(f"stream {s.id} has both values and markers")
            self.counts[s.id] = [None, None, 0]
            self.put(xdf.stream_head(s))
        if len(values) != s.channels:
            raise ValueError(f"a sample has {len(values)} channels, its stream {s.channels}")
        s.stamps.append(stamp)
        s.values.append(values)
        if len(s.stamps) >= self.chunk_samples:
            self.flush(s)

    def flush(self, s: xdf.Stream) -> None:
        if s.stamps:
            self.put(xdf.samples(s, s.stamps, s.values))
            first, _, n = self.counts[s.id]
            self.counts[s.id] = [s.stamps[0] if n == 0 else first, s.stamps[-1], n + len(s.stamps)]
            s.stamps, s.values = [], []
            if self.since >= BOUNDARY_BYTES:
                self.put(xdf.chunk(xdf.BOUNDARY, xdf.BOUNDARY_MARK))
                self.since = 0

    def close(self) -> tuple[str, int]:
        for s in self.streams.values():
            self.flush(s)
            self.put(xdf.stream_foot(s, *self.counts[s.id]))
        self.out.close()
        return self.name, self.size


class XdfWriter(DataSourceArrowWriter):
    """Rows to files; what a job wrote counts once its list is there."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.options = options["path"].rstrip("/"), options
        names = [f.name for f in schema.fields]
        if "recording" not in names or "ts" not in names or not {"values", "marker"} & set(names):
            raise ValueError("recordings need the columns recording, ts, and values or marker")
        if unknown := set(names) - set(xdf.COLUMNS):
            raise ValueError(f"a recording has no columns {sorted(unknown)}")
        self.replaced = [log.rsplit("/", 1)[1] for log, _ in files.listed(f"{self.path}/{COMMITTED}", ".json")] if overwrite and files.exists(f"{self.path}/{COMMITTED}") else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        chunk_samples, rate = int(o.get("chunksamples", CHUNK_SAMPLES)), float(o.get("rate", 0))
        given = o["labels"].split(",") if o.get("labels") else []
        open_: dict[object, _File] = {}
        done: list[tuple[str, int]] = []
        try:
            for batch in iterator:
                columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                none = [None] * batch.num_rows
                for rec, number, name, kind, labels, ts, values, marker in zip(*(columns.get(c, none) for c in xdf.COLUMNS)):
                    if values is None and marker is None:
                        continue
                    file = open_.pop(rec, None)
                    if file is None:
                        if len(open_) >= MOST_OPEN:  # the one that was used least lately
                            done.append(open_.pop(next(iter(open_))).close())
                        file = _File(self.path, rec, chunk_samples)
                    open_[rec] = file
                    text = values is None
                    if not text and values and isinstance(values[0], list):
                        values = values[0]
                    number = (2 if text else 1) if number is None else number

                    def make(n: int) -> xdf.Stream:
                        plain = ("markers", "Markers", "string", 0.0) if text else (o.get("name", "untitled"), o.get("type", "EEG"), "double64", rate)
                        return xdf.Stream(number, plain[0] if name is None else name, plain[1] if kind is None else kind, plain[2], n, plain[3], list(labels or ([] if text else given)))

                    file.push((number, text), make, time.time() if ts is None else ts, [marker] if text else [math.nan if v is None else v for v in values])
            while open_:
                done.append(open_.popitem()[1].close())
        except BaseException:
            for f in open_.values():
                f.out.close()
            for name in [f.name for f in open_.values()] + [n for n, _ in done]:
                files.removed(f"{self.path}/{name}")
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        self._list(f"batch-{time.time_ns():020d}-{uuid.uuid4().hex}", messages)

    def abort(self, messages: list[Written | None]) -> None:
        for name, _ in self._names(messages):
            files.removed(f"{self.path}/{name}")

    def _names(self, messages) -> list[tuple[str, int]]:
        return [n for m in messages if m is not None for n in m.names]

    def _list(self, name: str, messages) -> None:
        files.put_json(f"{self.path}/{COMMITTED}/{name}.json", {"files": self._names(messages), "replaces": self.replaced})


class XdfStreamWriter(DataSourceStreamArrowWriter):
    """Micro-batches to files, each exactly once: a batch that is listed already isn't listed again, and its new files go."""

    def __init__(self, options: dict, schema):
        self.plain = XdfWriter(options, schema, False)
        if not options.get("checkpointlocation"):
            raise ValueError("a stream to recordings needs the option checkpointLocation")
        self.query = hashlib.sha256(options["checkpointlocation"].encode()).hexdigest()[:16]  # two queries may write to one folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.plain.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        name = f"stream-{self.query}-{batchId:020d}"
        if files.exists(f"{self.plain.path}/{COMMITTED}/{name}.json"):
            self.plain.abort(messages)
        else:
            self.plain._list(name, messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.plain.abort(messages)


class XdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xdf"

    def schema(self) -> str:
        return xdf.SCHEMA

    def reader(self, schema) -> XdfReader:
        return XdfReader(self.options, schema)

    def streamReader(self, schema) -> XdfStreamReader:
        return XdfStreamReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> XdfWriter:
        return XdfWriter(self.options, schema, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> XdfStreamWriter:
        return XdfStreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(XdfDataSource)


def _with(reader, options: dict):
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name.rstrip("_"), ",".join(map(str, value)) if isinstance(value, (list, tuple)) else value)
    return reader


def reader(spark: SparkSession, **options: object) -> DataFrameReader:
    """``spark.read.format("xdf")`` of a session that knows it; options as arguments (``from_`` for from), lists as such."""
    register(spark)
    return _with(spark.read.format("xdf"), options)


def stream_reader(spark: SparkSession, **options: object) -> DataStreamReader:
    """``spark.readStream.format("xdf")`` of a session that knows it; options as in ``reader``."""
    register(spark)
    return _with(spark.readStream.format("xdf"), options)
