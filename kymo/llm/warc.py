"""WARC 1.1 archives: a writer with chunked framing, revisits and segmentation, and a reader that reassembles segments.

Writing. Each row is one capture. Of captures with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
smallest key is a ``response``, the others are ``revisit`` records that refer to it by record id. A response's block is
an HTTP message whose body is in chunked transfer framing; a block of more than ``SEGMENT_BYTES`` is cut into a first
segment and ``continuation`` records (WARC-Segment-Origin-ID, WARC-Segment-Number, and on the last
WARC-Segment-Total-Length). A record ends with CR LF CR LF, which is the line separator of Spark's text sink, so the
archive files are plain gzipped WARC files written and committed by Spark to any store.

Reading. A gzipped file isn't split, so its pieces between blank lines stream in order through one task, which puts
records together by Content-Length: memory holds one record. Continuations are grouped by their origin's id,
ordered by segment number, and checked against the total length; then chunked framing is decoded and the payload is
checked against its digest. A group is one record's segments, so it is as large as that record. Revisits find their
response in a join that Spark may split where one response has very many.

Results: a null payload counts as empty and is a response, as is any payload below the bound. Null keys sort after all
others. Rows that repeat a key are captures of their own; of equal ones the first as they were written is the response. A
key that isn't a whole number is an error. An empty table gives an archive without records. A broken archive (wrong length, missing segment, wrong digest) raises an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm.common import fresh_path, map_rows, numbered, tune, whole_key, written

LEAST_REVISIT, SEGMENT_BYTES, CHUNK_BYTES = 100, 32 << 10, 8 << 10
# Framing of the WARC and HTTP formats.
END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

CAPTURES = "key long, url string, payload binary, row long, digest string, first_row long, first_key long"
RECORDS = "record_id string, kind string, key long, url string, digest string, refers_to string, origin string, segment int, total long, block binary"


def record_id(key: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{key}:{row}'.encode()).digest())}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked framing of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing (chunk extensions and trailers are skipped)."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(parts)
        at = end + 2
        parts.append(body[at : at + n])
        if len(parts[-1]) != n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(END)
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
        return unchunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def capture_records(key: int | None, url: str | None, payload: bytes, row: int, digest: str, first_row: int | None, first_key: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one capture, without their closing blank line."""
    me, common = record_id(key, row), [("WARC-Date", DATE), ("WARC-Target-URI", _uri(url))]
    named = [("X-Capture-Key", key), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = ("Content-Type", "application/http; msgtype=response")
    if first_row is not None and first_row != row:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, *named, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_key, first_row)), http], REVISIT_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    first, rest = block[:segment_bytes], block[segment_bytes:]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, *named, ("WARC-Segment-Number", 1 if rest else None), http], first)
    for number, at in enumerate(range(0, len(rest), segment_bytes), 2):
        last = at + segment_bytes >= len(rest)
        own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{me}:{number}'.encode()).digest())}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if last else None)], rest[at : at + segment_bytes])


def captures(df: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Rows as ``CAPTURES``: payload, digest and the capture that is the response of equal payloads."""
    payload = F.coalesce(df[text].cast("binary"), F.lit(b""))
    rows, row = numbered(df.select(
        whole_key(df, key).alias("key"), df[url].alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")), "warc-rows")
    rows = rows.withColumnRenamed(row, "row")
    first = F.min(F.struct(F.col("key").isNull(), "key", "row"))
    firsts = rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(first.alias("f"), F.count("*").alias("n")).filter("n > 1")
    # Written, so that its size is known when the join is planned: payloads only move where it is above Spark's bound for
    # broadcasts, and then both sides have an exchange and a very frequent payload can be split.
    firsts = written(firsts.select("digest", F.col("f.row").alias("first_row"), F.col("f.key").alias("first_key")), "warc-firsts")
    return rows.join(firsts, "digest", "left").select("key", "url", "payload", "row", "digest", "first_row", "first_key")


def write_archive(df: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a frame's captures to gzipped WARC files under ``path``."""
    tune(df.sparkSession)

    def per_batch(columns: dict) -> dict:
        names = ("key", "url", "payload", "row", "digest", "first_row", "first_key")
        return {"value": [r for c in zip(*(columns[n].to_pylist() for n in names)) for r in capture_records(*c, segment_bytes)]}

    records = map_rows(captures(df, key, url, text), per_batch, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Records of a stream that was cut at blank lines.

    A block that ends in CR LF meets a blank line two bytes before its closing one. Its last piece then runs on into the
    next head, which is given back behind the closing CR LF CR LF.
    """
    ahead = b""  # the next head, where it has been read already
    while (head := ahead or next(pieces, None)) is not None:
        ahead = b""
        if not head.startswith(VERSION):
            raise ValueError(f"not a WARC record: {head[:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8").partition(":") for line in head.split(b"\r\n")[1:])}
        need, parts, have = int(fields["content-length"]), [], -len(END)
        while have < need:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a record is cut short")
            parts.append(piece)
            have += len(END) + len(piece)
        block = END.join(parts)
        if have != need:
            if block[need : need + len(END)] != END:
                raise ValueError(f"a record's block has {have} bytes, not {need}")
            block, ahead = block[:need], block[need + len(END) :]
        key, number, total = (fields.get(n) for n in ("x-capture-key", "warc-segment-number", "warc-segment-total-length"))
        yield (
            fields["warc-record-id"], fields["warc-type"], key and int(key), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            fields.get("warc-refers-to"), fields.get("warc-segment-origin-id"), number and int(number), total and int(total), block)


_PARSED = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for record in _parse(p.as_py() for b in batches for p in b.column(0)):
        out.append(record)
        held += len(record[-1])
        if held > 8 << 20 or len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PARSED)], schema=_PARSED)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PARSED)], schema=_PARSED)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive files under ``path``, as ``RECORDS``."""
    tune(spark)
    pieces = spark.read.option("lineSep", END.decode()).text(path)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_records, RECORDS)


def _joined(columns: dict) -> dict:
    blocks = []
    for parts, total in zip(columns["parts"].to_pylist(), columns["total"].to_pylist()):
        if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
            raise ValueError("a segment is missing or repeated")
        blocks.append(b"".join(p["block"] for p in parts))
        if len(blocks[-1]) != total:
            raise ValueError(f"segments have {len(blocks[-1])} bytes, not {total}")
    return {n: columns[n] for n in ("record_id", "kind", "key", "url", "digest", "refers_to")} | {"block": blocks}


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, kind, key, url, digest, refers_to, block): records with whole blocks."""
    names = ["record_id", "kind", "key", "url", "digest", "refers_to"]
    whole = records.filter("segment is null").select(*names, "block")
    cut = records.filter("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    first = F.max(F.when(F.col("segment") == 1, F.struct(*names))).alias("first")
    groups = cut.groupBy("of").agg(first, F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    groups = groups.select("first.*", "total", "parts")
    return whole.unionAll(map_rows(groups, _joined, "record_id string, kind string, key long, url string, digest string, refers_to string, block binary"))


def _payloads(columns: dict) -> dict:
    payloads = []
    for kind, digest, block in zip(*(columns[n].to_pylist() for n in ("kind", "digest", "block"))):
        payload = payload_of(block) if kind == "response" else None
        if payload is not None and digest != hashlib.sha256(payload).hexdigest():
            raise ValueError("a payload differs from its digest")
        payloads.append(payload)
    return {n: columns[n] for n in ("record_id", "kind", "key", "url", "digest", "refers_to")} | {"payload": payloads}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, key, url, digest, refers_to, payload) of every capture; payload is null for revisits."""
    return map_rows(reassembled(read_records(spark, path)), _payloads, "record_id string, kind string, key long, url string, digest string, refers_to string, payload binary")


def index_archive(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to): every capture, revisits with what their response holds."""
    slim = written(read_archive(spark, path).select("record_id", "kind", "key", "digest", "refers_to", F.octet_length("payload").cast("long").alias("bytes")), "warc-index")
    own = slim.filter("kind = 'response'")
    direct = own.select("key", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    response = own.select(F.col("record_id").alias("refers_to"), F.col("key").alias("of_key"), "bytes", F.col("digest").alias("of_digest"))
    again = slim.filter("kind = 'revisit'").select("key", "digest", "refers_to").join(response, "refers_to", "left")
    checked = F.when(F.col("digest") == F.col("of_digest"), F.col("of_digest")).otherwise(F.raise_error(F.lit("a revisit differs from what it refers to")))
    return direct.unionAll(again.select("key", F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("of_key").alias("refers_to")))


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write an archive of all rows to the shared folder and index what reading it back gives."""
    path = fresh_path(df.sparkSession, "warc")
    write_archive(df, path, key, url, text, segment_bytes)
    return index_archive(df.sparkSession, path)
