"""XDF recordings (the Extensible Data Format, a public specification).

A file is a magic word and chunks: the number of length bytes, the length, a tag, and the content. Stream headers and
footers are XML, sample chunks hold values with optional time stamps, clock-offset chunks relate a stream's clock to the
recorder's.

A file is read by an index of its chunks, for which only their heads are read. Chunks of numbers are decoded as numpy records: as
all samples of such a chunk have the same size (stamped throughout, or not at all), any part of it can be read alone. So
a file splits by bytes anywhere, down to single samples, and what is held at a time is a piece of ``PIECE_BYTES``.

``spark.read.format("xdf")`` and streams are in ``kymo.sources.xdf_source``; ``read_contents`` takes files that Spark has read
already, such as those in a store that only Spark reaches.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.session import ship_package

# Chunk tags, sample formats and the boundary mark of the format's specification.
FILE_HEADER, STREAM_HEADER, SAMPLES, CLOCK_OFFSET, BOUNDARY, STREAM_FOOTER = 1, 2, 3, 4, 5, 6
FORMATS = {"float32": "<f4", "double64": "<f8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8"}
MAGIC = b"XDF:"
BOUNDARY_MARK = bytes.fromhex("43a546dccbf5410fb30ed5467383cbe4")

#: Bytes of a chunk's head that are read with it: length, tag, stream, count, and the first sample's stamp.
HEAD = 64
PIECE_BYTES = 4 << 20

SCHEMA = "recording string, stream int, name string, type string, labels array<string>, ts double, values array<double>, marker string"


@dataclass
class Clock:
    """The line through measured offsets of a stream's clock, from running sums, so that it can go on where it stood."""

    n: int = 0
    start: float = 0.0
    t: float = 0.0
    o: float = 0.0
    tt: float = 0.0
    to: float = 0.0

    def add(self, when: float, offset: float) -> None:
        if not self.n:
            self.start = when
        d = when - self.start
        self.n, self.t, self.o, self.tt, self.to = self.n + 1, self.t + d, self.o + offset, self.tt + d * d, self.to + d * offset

    def corrected(self, times: np.ndarray) -> np.ndarray:
        """Times on the recorder's clock."""
        if not self.n:
            return times
        spread = self.n * self.tt - self.t * self.t
        slope = (self.n * self.to - self.t * self.o) / spread if spread > 0 else 0.0
        return times + (self.o - slope * self.t) / self.n + slope * (times - self.start)


@dataclass
class Stream:
    """One stream of a recording."""

    id: int
    name: str
    type: str
    format: str
    channels: int
    rate: float
    labels: list[str]
    stamps: list[float] = field(default_factory=list)
    values: list = field(default_factory=list)
    clock: list[tuple[float, float]] = field(default_factory=list)

    def times(self) -> np.ndarray:
        """Time stamps on the recorder's clock: the line through the measured offsets is added."""
        line = Clock()
        for when, offset in self.clock:
            line.add(when, offset)
        return line.corrected(np.array(self.stamps, float))

    @property
    def text(self) -> bool:
        return self.format not in FORMATS

    @property
    def item(self) -> int:
        """Bytes of the values of a sample of numbers."""
        return self.channels * int(FORMATS[self.format][2])

    @classmethod
    def from_xml(cls, number: int, xml: str) -> Stream:
        info = ET.fromstring(xml)
        labels = [c.findtext("label", "") for c in info.iterfind("desc/channels/channel")]
        return cls(number, info.findtext("name", ""), info.findtext("type", ""), info.findtext("channel_format", "float32"), int(info.findtext("channel_count", "1")), float(info.findtext("nominal_srate", "0") or 0), labels)


def _length(data: bytes, at: int) -> tuple[int, int]:
    """(a variable-length integer, where it ends)."""
    n = data[at]
    if n not in (1, 4, 8):
        raise ValueError("a length has 1, 4 or 8 bytes")
    return int.from_bytes(data[at + 1 : at + 1 + n], "little"), at + 1 + n


# How the samples of a chunk lie: each with its stamp, none with one, or in another way (mixed stamps, text).
STAMPED, BARE, MIXED = 0, 1, 2


@dataclass
class Chunk:
    """Samples of one stream that lie in one way."""

    stream: int
    at: int
    end: int
    count: int
    kind: int
    before: int  # the chunk of this stream before it, -1 if none


class Index:
    """Streams, clocks and sample chunks of a file, from the heads of its chunks between two places.

    ``stop`` is where it ended: behind the last whole chunk. With ``live`` a chunk that is cut short is left for later (it is
    still being written), otherwise it is an error. A reader that goes on from a place gives the headers, clocks and last
    stamps that were known there.
    """

    def __init__(self, file: pa.NativeFile, size: int, start: int | None = None, live: bool = False, headers: dict[int, tuple[int, int]] | None = None,
                 clocks: dict[int, Clock] | None = None, last: dict[int, float] | None = None, most: int | None = None):
        self.file = file
        self.streams: dict[int, Stream] = {}
        self.headers = dict(headers or {})
        self.clocks = dict(clocks or {})
        self.first_last = dict(last or {})
        self.chunks: list[Chunk] = []
        self._newest: dict[int, int] = {}
        self._last: dict[int, float | None] = {}
        for number, (at, end) in self.headers.items():
            self._header(number, at, end)
        if not start:
            if live and size < len(MAGIC):
                self.stop = 0
                return
            if file.read_at(len(MAGIC), 0) != MAGIC:
                raise ValueError("not an XDF file")
            start = len(MAGIC)
        at, self.stop = start, start
        while at < size:
            head = file.read_at(HEAD, at)
            try:
                length, body = _length(head, 0)
            except IndexError:
                length, body = size, 0
            if at + body + length > size:
                if live:
                    break
                raise ValueError("a chunk is cut short")
            if length < 2:
                raise ValueError("a chunk without a tag")
            self._chunk(int.from_bytes(head[body : body + 2], "little"), head[body + 2 : body + length], at + body + 2, at + body + length)
            at += body + length
            self.stop = at
            if most is not None and at - start >= most:
                break

    def _header(self, number: int, at: int, end: int) -> None:
        self.streams[number] = Stream.from_xml(number, self.file.read_at(end - at, at).decode("utf-8"))
        self.headers[number] = (at, end)
        self.clocks.setdefault(number, Clock())

    def _known(self, number: int) -> Stream:
        if number not in self.streams:
            raise ValueError(f"stream {number} has no header")
        return self.streams[number]

    def _chunk(self, tag: int, head: bytes, at: int, end: int) -> None:
        if tag not in (STREAM_HEADER, SAMPLES, CLOCK_OFFSET):
            return
        number = struct.unpack_from("<I", head)[0]
        if tag == STREAM_HEADER:
            self._header(number, at + 4, end)
        elif tag == CLOCK_OFFSET:
            self._known(number)
            self.clocks[number].add(*struct.unpack_from("<dd", head, 4))
        else:
            stream = self._known(number)
            count, body = _length(head, 4)
            at += body
            if not count:
                return
            if stream.text:
                self._add(number, at, end, count, MIXED)
                return
            stamps, rest = divmod(end - at - count * (1 + stream.item), 8)
            if rest or not 0 <= stamps <= count:
                raise ValueError("a chunk's size doesn't fit its samples")
            if stamps in (0, count):
                self._add(number, at, end, count, STAMPED if stamps else BARE)
            elif stamps == 1 and head[body] == 8:
                self._add(number, at, at + 9 + stream.item, 1, STAMPED)
                self._add(number, at + 9 + stream.item, end, count - 1, BARE)
            else:
                self._add(number, at, end, count, MIXED)

    def _add(self, number: int, at: int, end: int, count: int, kind: int) -> None:
        self.chunks.append(Chunk(number, at, end, count, kind, self._newest.get(number, -1)))
        self._newest[number] = len(self.chunks) - 1

    def last_stamp(self, place: int, number: int) -> float | None:
        """The stamp of the last sample of chunk ``place`` of a stream (-1: before the first), its own or one that follows at the nominal rate; None without samples."""
        open_, at = [], place
        while at >= 0 and at not in self._last and self._begins_bare(self.chunks[at]):
            open_.append(at)
            at = self.chunks[at].before
        if at < 0:
            stamp = self.first_last.get(number)
        elif at in self._last:
            stamp = self._last[at]
        elif self.chunks[at].kind == STAMPED:
            stamp = struct.unpack("<d", self.file.read_at(8, self.chunks[at].end - self.streams[number].item - 8))[0]
        else:
            stamp = float(self._walked(self.chunks[at], None)[0][-1])
        for p in [at] * (at >= 0) + open_[::-1]:
            if p != at:
                c = self.chunks[p]
                stamp = float(self._following(stamp, c.count, self.streams[number].rate, c.count - 1)[0] if c.kind == BARE else self._walked(c, stamp)[0][-1])
            self._last[p] = stamp
        return stamp

    def _begins_bare(self, chunk: Chunk) -> bool:
        return chunk.kind == BARE or (chunk.kind == MIXED and not self.file.read_at(1, chunk.at)[0])

    def newest_stamps(self) -> dict[int, float]:
        """The last stamp of each stream."""
        found = {number: self.last_stamp(self._newest.get(number, -1), number) for number in self.streams}
        return {k: v for k, v in found.items() if v is not None}

    @staticmethod
    def _following(stamp: float | None, n: int, rate: float, skip: int = 0) -> np.ndarray:
        """Stamps of ``n`` samples behind one with ``stamp``, without the first ``skip``; without a rate or stamp they begin at 0."""
        if not rate:
            return np.zeros(n - skip)
        return np.arange(skip, n) / rate if stamp is None else stamp + np.arange(skip + 1, n + 1) / rate

    def _walked(self, chunk: Chunk, stamp: float | None) -> tuple[np.ndarray, list]:
        """(stamps, values) of a chunk with mixed stamps or of text, sample by sample, behind a sample with ``stamp``."""
        stream = self.streams[chunk.stream]
        body, at = self.file.read_at(chunk.end - chunk.at, chunk.at), 0
        stamps, values = [], []
        for _ in range(chunk.count):
            stamped, at = body[at], at + 1
            if stamped:
                stamp = struct.unpack_from("<d", body, at)[0]
                at += 8
            else:
                stamp = float(self._following(stamp, 1, stream.rate)[0])
            stamps.append(stamp)
            if stream.text:
                row = []
                for _ in range(stream.channels):
                    n, at = _length(body, at)
                    row.append(body[at : at + n].decode("utf-8"))
                    at += n
                values.append(row)
            else:
                values.append(np.frombuffer(body, FORMATS[stream.format], stream.channels, at))
                at += stream.item
        return np.array(stamps), values

    def pieces(self, low: int = 0, high: int | None = None, wanted: Sequence[int] | None = None) -> Iterator[tuple[Stream, np.ndarray, object]]:
        """(stream, stamps, values) of the samples that begin between two places of the file, some at a time.

        Values are an array (samples, channels) or, of text, lists; stamps aren't corrected.
        """
        for place, c in enumerate(self.chunks):
            if c.end <= low or (high is not None and c.at >= high) or (wanted is not None and c.stream not in wanted):
                continue
            stream = self.streams[c.stream]
            if c.kind == MIXED:
                if c.at >= low:
                    stamps, values = self._walked(c, self.last_stamp(c.before, c.stream) if self._begins_bare(c) else None)
                    self._last[place] = float(stamps[-1])
                    yield stream, stamps, values if stream.text else np.stack(values)
                continue
            record = np.dtype(([("n", "u1"), ("t", "<f8")] if c.kind == STAMPED else [("n", "u1")]) + [("v", FORMATS[stream.format], (stream.channels,))])
            first = max(0, -(-(low - c.at) // record.itemsize))
            end = c.count if high is None else min(c.count, -(-(high - c.at) // record.itemsize))
            step = max(1, PIECE_BYTES // record.itemsize)
            for i in range(first, end, step):
                n = min(step, end - i)
                some = np.frombuffer(self.file.read_at(n * record.itemsize, c.at + i * record.itemsize), record)
                stamps = some["t"] if c.kind == STAMPED else self._following(self.last_stamp(c.before, c.stream), i + n, stream.rate, i)
                yield stream, stamps, some["v"]


def parse(data: bytes) -> list[Stream]:
    """All streams of a file's bytes."""
    index = Index(pa.BufferReader(data), len(data))
    for stream, stamps, values in index.pieces():
        stream.stamps.extend(stamps.tolist())
        stream.values.extend(values if stream.text else values.astype(float))
    for number, when, offset in clock_offsets(data):
        index.streams[number].clock.append((when, offset))
    return list(index.streams.values())


def clock_offsets(data: bytes) -> Iterator[tuple[int, float, float]]:
    """(stream, when, offset) of all measurements of a file's bytes."""
    at = len(MAGIC)
    while at < len(data):
        length, at = _length(data, at)
        if int.from_bytes(data[at : at + 2], "little") == CLOCK_OFFSET:
            yield struct.unpack_from("<Idd", data, at + 2)
        at += length


def _repeated(value: object, n: int, kind: pa.DataType) -> pa.Array:
    return pa.array([value], kind).take(pa.array(np.zeros(n, np.int32)))


def batches(index: Index, recording: str, columns: Sequence[str], low: int = 0, high: int | None = None, wanted: Sequence[int] | None = None,
            channels: Sequence[str] | None = None, keep=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the given columns of ``SCHEMA``. ``channels`` are labels or numbers; ``keep`` gives a mask for corrected times."""
    for stream, stamps, values in index.pieces(low, high, wanted):
        times = index.clocks[stream.id].corrected(stamps)
        if keep is not None:
            mask = keep(times)
            if not mask.any():
                continue
            if not mask.all():
                times, values = times[mask], [v for v, m in zip(values, mask) if m] if stream.text else values[mask]
        n = len(times)
        if channels is not None and not stream.text:
            values = values[:, [int(c) if c not in stream.labels and c.lstrip("-").isdigit() else stream.labels.index(c) for c in channels]]
        made = {
            "recording": lambda: _repeated(recording, n, pa.string()), "stream": lambda: _repeated(stream.id, n, pa.int32()), "name": lambda: _repeated(stream.name, n, pa.string()),
            "type": lambda: _repeated(stream.type, n, pa.string()), "labels": lambda: _repeated(stream.labels, n, pa.list_(pa.string())), "ts": lambda: pa.array(np.ascontiguousarray(times, float)),
            "values": lambda: pa.nulls(n, pa.list_(pa.float64())) if stream.text else pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values, float).reshape(-1))),
            "marker": lambda: pa.array([v[0] if v else None for v in values] if stream.text else [None] * n, pa.string()),
        }
        yield pa.RecordBatch.from_arrays([made[c]() for c in columns], names=list(columns))


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_buffer()
            yield from batches(Index(pa.BufferReader(data), data.size), path, COLUMNS)


def read_xdf(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Every sample of every stream of the files at ``path``, as ``SCHEMA``; text streams have markers, others values.

    Options are those of ``kymo.sources.xdf_source``, such as types=["EEG"], channels=["C3", "C4"], from_=10.0, until=20.0.
    """
    from kymo.sources import xdf_source

    return xdf_source.reader(spark, **options).load(path)


def read_contents(files: DataFrame) -> DataFrame:
    """As ``read_xdf``, of files given as (path, content), such as Spark's ``binaryFile`` gives. A file is a row of one task."""
    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(_rows, SCHEMA)


def signal_and_markers(df: DataFrame, stream_type: str = "EEG") -> tuple[DataFrame, DataFrame]:
    """(signal, markers) of each recording: the stream of ``stream_type``, and the marker stream with the most markers.

    Streams of the types Marker and Markers hold markers. Of those with equally many the one with the least number counts.
    """
    signal = df.filter(F.col("type") == stream_type).select("recording", "ts", "values")
    texts = df.filter(F.col("type").isin("Marker", "Markers") & F.col("marker").isNotNull())
    longest = texts.groupBy("recording", "stream").agg(F.count("*").alias("n")).groupBy("recording").agg(F.max_by("stream", F.struct("n", -F.col("stream"))).alias("stream"))
    return signal, texts.join(longest, ["recording", "stream"]).select("recording", "ts", "marker")


# ---- writing ----


def chunk(tag: int, body: bytes) -> bytes:
    """A chunk of a file."""
    return b"\x08" + struct.pack("<QH", len(body) + 2, tag) + body if len(body) > 0xFFFFFF00 else b"\x04" + struct.pack("<IH", len(body) + 2, tag) + body


def file_head() -> bytes:
    return MAGIC + chunk(FILE_HEADER, b"<?xml version='1.0'?><info><version>1.0</version></info>")


def stream_head(s: Stream) -> bytes:
    labels = "".join(f"<channel><label>{escape(x)}</label></channel>" for x in s.labels)
    xml = (f"<?xml version='1.0'?><info><name>{escape(s.name)}</name><type>{escape(s.type)}</type><channel_count>{s.channels}</channel_count>"
           f"<nominal_srate>{s.rate}</nominal_srate><channel_format>{s.format}</channel_format><desc><channels>{labels}</channels></desc></info>")
    return chunk(STREAM_HEADER, struct.pack("<I", s.id) + xml.encode("utf-8"))


def stream_foot(s: Stream, first: float | None, last: float | None, count: int) -> bytes:
    xml = f"<?xml version='1.0'?><info><first_timestamp>{first}</first_timestamp><last_timestamp>{last}</last_timestamp><sample_count>{count}</sample_count></info>"
    return chunk(STREAM_FOOTER, struct.pack("<I", s.id) + xml.encode("utf-8"))


def samples(s: Stream, stamps: Sequence[float], values: Sequence) -> bytes:
    """A chunk of samples, each with its stamp."""
    head = struct.pack("<I", s.id) + b"\x04" + struct.pack("<I", len(stamps))
    if not s.text:
        records = np.empty(len(stamps), np.dtype([("n", "u1"), ("t", "<f8"), ("v", FORMATS[s.format], (s.channels,))]))
        records["n"], records["t"] = 8, stamps
        records["v"] = np.asarray(values, FORMATS[s.format]).reshape(len(stamps), s.channels)
        return chunk(SAMPLES, head + records.tobytes())
    body = [head]
    for stamp, row in zip(stamps, values):
        body += [b"\x08", struct.pack("<d", stamp)]
        for text in row:
            data = text.encode("utf-8")
            body += [b"\x04", struct.pack("<I", len(data)), data]
    return chunk(SAMPLES, b"".join(body))


def write_xdf(streams: list[Stream]) -> bytes:
    """The bytes of a file with these streams, for tests and small exports; ``df.write.format("xdf")`` is for tables."""
    out = [file_head()]
    for s in streams:
        out.append(stream_head(s))
        out += [chunk(CLOCK_OFFSET, struct.pack("<Idd", s.id, when, offset)) for when, offset in s.clock]
        out.append(samples(s, s.stamps, s.values))
    return b"".join(out)
