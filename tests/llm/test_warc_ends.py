"""WARC records whose block ends in CR LF, alone or before other line ends."""

import collections
import random

import pytest

from kymo.llm import warc

PAGES = "page_id long, url string, html string"


def record(block):
    return b"\r\n".join([b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <a>", b"Content-Length: %d" % len(block)]) + warc.END + block + warc.END


def pieces(stream):
    """What a text reader gives: no piece for an empty rest."""
    out = stream.split(warc.END)
    return iter(out if out[-1] else out[:-1])


def test_blocks_are_cut_at_their_length():
    blocks = [b"abc\r\n", b"", b"\r\n", b"x\r\n\r\n", b"x\r\n\r\n\r\n", b"\r", b"\n\r\n", b"a\r\n\r\nb\r\n", b"end\r\n"]
    rng = random.Random(1)
    for _ in range(300):
        some = [rng.choice(blocks) for _ in range(rng.randint(1, 6))]
        assert [r[-1] for r in warc._parse(pieces(b"".join(map(record, some))))] == some
    with pytest.raises(ValueError):
        list(warc._parse(pieces(record(b"abc\r\n").replace(b": 5", b": 4"))))


def test_segments_that_end_in_line_ends(spark):
    sizes = [32646, 32647, 32648, 65382, 65383]
    rows = [(i, "u", "x" * n) for i, n in enumerate(sizes)] + [(100 + i, "u", ("y" * i + "\r\n") * (40_000 // (i + 2))) for i in range(6)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert collections.Counter((r["key"], r["payload_bytes"]) for r in got) == collections.Counter((i, len(h)) for i, _, h in rows)


def test_every_length_near_a_cut(spark):
    rows = [(n, "u", ("ab\r\n" * 200)[:n]) for n in range(300, 400)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(2), segment_bytes=101).collect()
    assert {r["key"]: r["payload_bytes"] for r in got} == {n: n for n, _, _ in rows}
