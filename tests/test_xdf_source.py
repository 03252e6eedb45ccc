"""XDF as a data source: parts of files, filters and columns, recordings that grow, and recordings that are written."""

import json
import struct
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kymo.sources import streams, xdf, xdf_source


def odd_file(seed=0, rate=50.0):
    """A file with all ways in which samples may lie, and the rows that it holds: (stream, ts, values, marker)."""
    rng = np.random.default_rng(seed)
    eeg = xdf.Stream(1, "amp <1>", "EEG", "float32", 3, rate, ["C3", "C&4", "Cz"])
    other = xdf.Stream(7, "slow", "Gaze", "int16", 1, 0.0, [])
    said = xdf.Stream(2, "m", "Markers", "string", 2, 0.0, [])
    out, want, last = [xdf.file_head(), xdf.stream_head(eeg), xdf.stream_head(said)], [], {}
    clock = xdf.Clock()
    for k in range(40):
        if k == 3:
            out.append(xdf.stream_head(other))
        if k % 5 == 0:
            when, offset = 10.0 * k, 0.5 + 0.001 * k
            out.append(xdf.chunk(xdf.CLOCK_OFFSET, struct.pack("<Idd", 1, when, offset)))
            clock.add(when, offset)
        if k % 7 == 6:
            out.append(xdf.chunk(xdf.BOUNDARY, xdf.BOUNDARY_MARK))
        n = int(rng.integers(1, 30))
        values = rng.normal(size=(n, 3)).astype("<f4")
        stamped = {0: np.ones(n, bool), 1: np.zeros(n, bool), 2: np.arange(n) == 0, 3: rng.random(n) < 0.5}[k % 4]
        body = struct.pack("<I", 1) + (b"\x01" + bytes([n]) if k % 2 else b"\x08" + struct.pack("<Q", n))
        for i in range(n):
            t = 100.0 + k + i / 64 if stamped[i] else (0.0 if 1 not in last else last[1] + 1 / rate)
            last[1] = t
            body += (b"\x08" + struct.pack("<d", t) if stamped[i] else b"\x00") + values[i].tobytes()
            want.append((1, t, values[i].astype(float).tolist(), None))
        out.append(xdf.chunk(xdf.SAMPLES, body))
        if k > 3 and k % 3 == 0:
            out.append(xdf.samples(other, [float(k), float(k) + 0.5], [[k], [-k]]))
            want += [(7, float(k), [float(k)], None), (7, k + 0.5, [-float(k)], None)]
        if k % 4 == 1:
            out.append(xdf.samples(said, [float(k)], [[f"mark é {k}", "second"]]))
            want.append((2, float(k), None, f"mark é {k}"))
    fixed = clock.corrected(np.array([w[1] for w in want]))
    return b"".join(out), [(s, float(c) if s == 1 else t, v, m) for (s, t, v, m), c in zip(want, fixed)]


def rows_of(df):
    return [(r["stream"], r["ts"], r["values"], r["marker"]) for r in df.collect()]


def same_rows(got, want):
    key = lambda r: (r[0], round(r[1], 6), str(r[2]), r[3] or "")
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want], rtol=0, atol=1e-9)


def test_any_cut_of_a_file_gives_every_sample_once():
    data, want = odd_file()
    whole = [r for b in xdf.batches(xdf.Index(pa.BufferReader(data), len(data)), "r", xdf.COLUMNS) for r in b.to_pylist()]
    same_rows([(r["stream"], r["ts"], r["values"], r["marker"]) for r in whole], want)
    rng = np.random.default_rng(1)
    for _ in range(25):
        cuts = [0, *sorted(rng.integers(0, len(data), rng.integers(1, 30)).tolist()), len(data)]
        got = []
        for low, high in zip(cuts, cuts[1:]):
            index = xdf.Index(pa.BufferReader(data), len(data))
            got += [(r["stream"], r["ts"], r["values"], r["marker"]) for b in xdf.batches(index, "r", xdf.COLUMNS, low, high) for r in b.to_pylist()]
        same_rows(got, want)


def test_splits_filters_and_columns(spark, tmp_path):
    wants = {}
    for i in range(3):
        data, wants[i] = odd_file(i)
        (tmp_path / f"{i}.xdf").write_bytes(data)
    (tmp_path / "notes.txt").write_text("not a recording")
    read = xdf_source.reader(spark)
    df = read.option("splitBytes", 1500).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 6
    same_rows(rows_of(df), wants[0] + wants[1] + wants[2])
    assert {(r["name"], r["type"], tuple(r["labels"])) for r in df.select("name", "type", "labels").distinct().collect()} == {("amp <1>", "EEG", ("C3", "C&4", "Cz")), ("slow", "Gaze", ()), ("m", "Markers", ())}
    low, high = 101.3, 120.0
    some = xdf.read_xdf(spark, str(tmp_path), splitBytes=1500, types=["EEG"], from_=low, until=high, recordings=[str(tmp_path / "1.xdf")])
    same_rows(rows_of(some), [w for w in wants[1] if w[0] == 1 and low <= w[1] < high])
    one = xdf.read_xdf(spark, str(tmp_path), splitBytes=1500, recordings=[str(tmp_path / "2.xdf")])
    assert one.rdd.getNumPartitions() < df.rdd.getNumPartitions() and one.count() == len(wants[2])
    assert xdf.read_xdf(spark, str(tmp_path), streams=[2, 7]).count() == sum(w[0] != 1 for k in wants for w in wants[k]) == xdf.read_xdf(spark, str(tmp_path), names=["m", "slow"]).count()
    both = df.filter("type = 'EEG'").select("ts").union(df.filter("type = 'Markers'").select("ts"))  # one relation twice, with other filters
    assert both.count() == sum(w[0] != 7 for k in wants for w in wants[k])
    slim = xdf_source.reader(spark, channels=["Cz", 0]).schema("ts double, values array<double>").load(str(tmp_path / "0.xdf"))
    assert slim.columns == ["ts", "values"]
    with pytest.raises(Exception, match="Cz"):
        slim.collect()  # the other stream has no channel Cz
    got = xdf.read_xdf(spark, str(tmp_path / "0.xdf"), channels=["Cz", 0], types=["EEG"])
    same_rows(rows_of(got), [(s, t, [v[2], v[0]], m) for s, t, v, m in wants[0] if s == 1])
    with pytest.raises(Exception, match="no columns"):
        xdf_source.reader(spark).schema("voltage double").load(str(tmp_path)).collect()


def test_empty_and_broken_files(spark, tmp_path):
    (tmp_path / "a.xdf").write_bytes(xdf.file_head())
    assert xdf_source.reader(spark).load(str(tmp_path)).count() == 0
    (tmp_path / "none").mkdir()
    assert xdf_source.reader(spark).load(str(tmp_path / "none")).count() == 0
    data, _ = odd_file()
    for bad in (b"", b"XD", b"nope", data[:-3], data + b"\x05", data + xdf.chunk(xdf.SAMPLES, struct.pack("<I", 99) + b"\x01\x01\x00")):
        with pytest.raises(ValueError):
            xdf.Index(pa.BufferReader(bad), len(bad))


def test_a_large_file_in_bounded_memory(spark, tmp_path):
    """One chunk of 180 MB is read by many tasks, each a piece at a time."""
    n = 700_000
    s = xdf.Stream(1, "amp", "EEG", "float32", 60, 500.0, [str(i) for i in range(60)])
    values = np.arange(n, dtype="<f4")[:, None] + np.zeros(60, "<f4")
    path = tmp_path / "large.xdf"
    with open(path, "wb") as f:
        f.write(xdf.file_head() + xdf.stream_head(s) + xdf.samples(s, np.arange(n) / 500.0, values))
    df = xdf_source.reader(spark).schema("ts double, values array<double>").option("splitBytes", 16 << 20).load(str(path))
    assert df.rdd.getNumPartitions() >= 8
    assert [b.num_rows * b.nbytes // b.num_rows for b in list(xdf.batches(xdf.Index(pa.memory_map(str(path)), path.stat().st_size), "r", ["values"]))[:3]][0] < 5 * xdf.PIECE_BYTES
    got = df.agg(F.count("*").alias("n"), F.sum(F.get("values", F.lit(59))).alias("s"), F.max("ts").alias("t")).first()
    assert (got["n"], got["s"], got["t"]) == (n, n * (n - 1) / 2, (n - 1) / 500.0)
    assert xdf.read_xdf(spark, str(path), from_=100, until=101).count() == 500


# ---- recordings that grow ----


def run_once(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_growing_recording_is_read_without_loss_or_repeats(spark, tmp_path):
    """Chunks come bit by bit, cut anywhere; queries stop and start again; corrected times equal the file reader's where offsets lie on a line."""
    folder = tmp_path / "rec"
    folder.mkdir()
    data, want = odd_file(3)
    places = [3, 60, 1000, 1001, len(data) // 3, len(data) // 2 + 7, len(data) - 1, len(data)]
    for i, place in enumerate(places):
        (folder / "a.xdf").write_bytes(data[:place])
        if i == 3:
            (folder / "b.xdf").write_bytes(data)  # a second recording starts
        run_once(xdf_source.stream_reader(spark).option("maxBytesPerTrigger", 4000).load(str(folder)), tmp_path / "out", tmp_path / "state")
    for _ in range(4):  # what the bound on bytes left over
        run_once(xdf_source.stream_reader(spark).option("maxBytesPerTrigger", 4000).load(str(folder)), tmp_path / "out", tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out"))
    for name in "ab":
        own = [r for r in rows_of(got.filter(F.col("recording").endswith(f"{name}.xdf")))]
        assert len(own) == len(want)
        later = lambda rows: [r for r in rows if r[0] != 1 or r[1] > 115]  # noqa: E731  (the first samples come before the second offset is measured)
        same_rows(later(own), later(want))
    before = got.count()
    run_once(xdf_source.stream_reader(spark).option("maxBytesPerTrigger", 4000).load(str(folder)), tmp_path / "out", tmp_path / "state")
    assert spark.read.parquet(str(tmp_path / "out")).count() == before


def test_a_live_query_follows_a_file(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    data, want = odd_file(4)

    def grow():
        with open(folder / "a.xdf", "wb") as f:
            for i in range(0, len(data), 2000):
                f.write(data[i : i + 2000])
                f.flush()
                time.sleep(0.1)

    writer = threading.Thread(target=grow)
    writer.start()
    q = xdf_source.stream_reader(spark).load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    writer.join()
    end = time.monotonic() + 60
    while time.monotonic() < end and sum(p["numInputRows"] for p in q.recentProgress) < len(want):
        time.sleep(0.2)
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


# ---- recordings that are written ----


def test_what_is_written_reads_back(spark, tmp_path):
    n = 5000
    df = spark.range(n).select(F.concat(F.lit("rec/ü "), F.col("id") % 3).alias("recording"), (F.col("id") / 100).alias("ts"), F.array(F.col("id").cast("double"), -F.col("id").cast("double")).alias("values"), F.lit(None).cast("string").alias("marker"))
    said = spark.range(30).select(F.concat(F.lit("rec/ü "), F.col("id") % 3).alias("recording"), F.col("id").cast("double").alias("ts"), F.lit(None).cast("array<double>").alias("values"), F.concat(F.lit("m"), F.col("id")).alias("marker"))
    nothing = spark.createDataFrame([("rec/ü 0", 1.0, None, None)], "recording string, ts double, values array<double>, marker string")
    xdf_source.register(spark)
    path = str(tmp_path / "rec")
    df.unionByName(said).unionByName(nothing).repartition(4, "recording").write.format("xdf").option("labels", "C3,C4").option("chunkSamples", 100).mode("append").save(path)
    back = xdf_source.reader(spark).load(path)
    signal, markers = xdf.signal_and_markers(back)
    assert sorted(signal.collect()) == sorted(df.select("recording", "ts", "values").collect())
    assert sorted(markers.collect()) == sorted(said.select("recording", "ts", "marker").collect())
    assert back.filter("type = 'EEG'").select("labels").distinct().collect()[0][0] == ["C3", "C4"]
    cut = streams.epochs(signal, markers.filter("marker = 'm3'"), 4, keep=("marker",)).collect()
    assert [r["data"] for r in cut] == [[300.0, 303.0, 306.0, 309.0, -300.0, -303.0, -306.0, -309.0]]
    df.limit(10).write.format("xdf").mode("append").save(path)
    assert xdf_source.reader(spark).load(path).count() == n + 40
    df.limit(10).write.format("xdf").mode("overwrite").save(path)
    assert xdf_source.reader(spark).load(path).count() == 10


def test_recordings_one_after_the_other(spark):
    """The order of recordings is that of their first markers, not that of their names."""
    signal = spark.createDataFrame([(r, float(i), [float(i)]) for r in "abc" for i in range(4)], "recording string, ts double, values array<double>")
    markers = spark.createDataFrame([("a", 3.0, "x"), ("b", 2.0, "x"), ("b", 9.0, "x"), ("a", 5.0, "y")], "recording string, ts double, marker string")
    got = streams.one_after_the_other(signal, markers).orderBy("first_marker", "recording", "ts").collect()
    assert [(r["recording"], r["first_marker"]) for r in got[::4]] == [("b", 2.0), ("a", 3.0)] and len(got) == 8


def test_push_rules(spark, tmp_path):
    xdf_source.register(spark)
    nested = spark.createDataFrame([("r", 1.0, [[1.0, 2.0], [3.0, 4.0]]), ("r", None, [[5.0, None]])], "recording string, ts double, values array<array<double>>")
    began = time.time()
    nested.coalesce(1).write.format("xdf").mode("append").save(str(tmp_path / "a"))
    got = {str(r["values"]): r["ts"] for r in xdf_source.reader(spark).load(str(tmp_path / "a")).collect()}
    assert got["[1.0, 2.0]"] == 1.0 and began <= got["[5.0, nan]"] <= time.time()
    wrong = spark.createDataFrame([("r", 1.0, [1.0, 2.0]), ("r", 2.0, [1.0])], "recording string, ts double, values array<double>").coalesce(1)
    with pytest.raises(Exception, match="1 channels, its stream 2"):
        wrong.write.format("xdf").mode("append").save(str(tmp_path / "b"))
    assert not list((tmp_path / "b").rglob("*.xdf"))
    for bad in ("recording string, ts double", "recording string, ts double, values array<double>, colour string"):
        with pytest.raises(Exception, match="column"):
            spark.createDataFrame([], bad).write.format("xdf").mode("append").save(str(tmp_path / "c"))


def test_streamed_recordings_are_written_exactly_once(spark, tmp_path):
    """A batch that fails leaves nothing; one that was committed before its query died isn't written again."""
    (tmp_path / "in").mkdir()
    schema = "recording string, ts double, values array<double>"

    def drop(i):
        spark.createDataFrame([(f"r{j % 2}", i + j / 10, [float(i), float(j)]) for j in range(10)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))

    def run():
        xdf_source.register(spark)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.writeStream.format("xdf").option("path", str(tmp_path / "rec")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    drop(0), run()
    drop(1), run()
    read = lambda: sorted((r["recording"], r["ts"], r["values"]) for r in xdf_source.reader(spark).load(str(tmp_path / "rec")).collect())
    want = read()
    assert len(want) == 20 and {r[0] for r in want} == {"r0", "r1"}
    # the query died after its commit and before Spark noted it: the batch runs again
    newest = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    run()
    assert read() == want
    # and it died before: files lie there that no list names
    orphan = tmp_path / "rec" / "recording=r0" / "orphan.xdf"
    orphan.write_bytes(next((tmp_path / "rec" / "recording=r0").glob("*.xdf")).read_bytes())
    assert read() == want
    log = sorted((tmp_path / "rec" / "_committed").glob("*.json"))
    assert len(log) == 2 and all(json.loads(p.read_text())["files"] for p in log)
    # a recording that is written by a stream is read by another
    run_once(xdf_source.stream_reader(spark).load(str(tmp_path / "rec")), tmp_path / "copy", tmp_path / "state2")
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 20


def test_short_recordings_come_together_and_are_read_once(spark, tmp_path, monkeypatch):
    """A task's small files give one batch; the catalog's queries read the files once, whatever uses their rows."""
    from kymo.plans import catalog_more

    xdf_source.register(spark)
    rows = spark.createDataFrame([(f"r{i}", float(k), [float(i)]) for i in range(30) for k in range(4)], "recording string, ts double, values array<double>")
    rows.repartition(1, "recording").write.format("xdf").mode("append").save(str(tmp_path / "many"))
    reader = xdf_source.XdfReader({"path": str(tmp_path / "many")}, xdf_source.reader(spark).load(str(tmp_path / "many")).schema)
    batches = [list(reader.read(p)) for p in reader.partitions()]
    assert [len(b) for b in batches] == [1] and batches[0][0].num_rows == 120
    monkeypatch.setattr(xdf_source, "TOGETHER", 50)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [48, 48, 24]
    read = catalog_more._recordings(spark, "/root/testdata/sf0.001")
    assert read.inputFiles() and all(".parquet" in f for f in read.inputFiles())
