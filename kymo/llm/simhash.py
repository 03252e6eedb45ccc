"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within 3 differing bits by anchor points.

Fingerprints. A-Z are lower-cased, words are runs without ASCII white space, shingles are ``width`` successive words
(repeats count). A bit is set if it is set in over half of the shingles' XXH64 hashes. Fewer words than ``width``
give one shingle, none gives fingerprint zero.

Anchors. Two fingerprints at ``THRESHOLD`` = 3 or fewer bits differ in at most one bit of one of their 32-bit halves.
The anchors of a half are the codewords of the perfect Hamming code of length 31 (covering radius 1), times the free
last bit. Each half belongs to the one anchor within the covering radius of it, its home, and is copied to every
anchor within covering radius plus the half's threshold, 1 + 1. If x and y differ in at most one bit of a half, the
home of x is within 2 of y: both meet there. An anchor is one of 2**27, so few fingerprints share one by chance.

Work per anchor: members sorted by anchor stream through a task; only distinct fingerprints take part, each link's
ends are compared in full (64 bits), and an anchor gives a spanning forest of its links, never all pairs. Members are counted
by anchor first. Those of an anchor with more than ``CELL`` never meet in one task: linked ones agree in one of the
four bytes of their other halves, at least, so each goes to four groups by these bytes; and a group that is still too large is
cut into cells by a hash of the fingerprint, of which pairs are compared in separate tasks.

Results: a null text has no words. Rows whose fingerprints are equal link, texts without words included. A null key
takes part in its component but never names it unless the component holds no other key. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import few, map_rows, numbered, tune, written
from kymo.llm.components import connected_components

WIDTH, SEED, THRESHOLD = 3, 42, 3
#: Members of an anchor compared in one piece.
CELL = 4096
PIECE = 1 << 16
#: Fingerprints a shuffle partition that are joined by broadcast, at most.
FREQUENT = 8


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))), "<u8", n)
    for i in range(0, n, PIECE):
        ones += np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""
    tune(df.sparkSession)

    def per_batch(columns: dict) -> dict:
        fps = np.fromiter((fingerprint(t.as_py(), width) for t in columns["text"]), np.uint64, len(columns["text"]))
        return {"key": columns["key"], "fp": fps.view(np.int64)}

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(df[key].alias("key"), df[text].alias("text")), per_batch, f"key {kind}, fp long").withColumnRenamed("key", key)


# Syndrome of each 16-bit piece of a half: bit i (0 to 30) of a half has column i + 1 of the Hamming code.
def _syndromes(offset: int) -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for i in range(min(16, 31 - offset)):
        out[(np.arange(1 << 16) >> i & 1).astype(bool)] ^= offset + i + 1
    return out


_LOW, _HIGH = _syndromes(0), _syndromes(16)
_FREE = np.uint32(1 << 31)


def homes(halves: np.ndarray) -> np.ndarray:
    """The anchor within distance 1 of each 32-bit half: its one wrong bit of the first 31 put right."""
    syndrome = _LOW[halves & 0xFFFF] ^ _HIGH[halves >> 16]
    return halves ^ np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint32), np.uint32(0)).astype(np.uint32)


def anchors_within(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into halves, anchor) for every anchor within distance 2, the home left out."""
    home, bits = homes(halves), np.uint32(1) << np.arange(31, dtype=np.uint32)
    near = homes(halves[:, None] ^ bits)  # what one flipped bit away calls home is within 2
    flipped = np.where((np.bitwise_count(home ^ halves) <= 1)[:, None], (home ^ _FREE)[:, None], home[:, None])
    every = np.sort(np.concatenate([near, flipped], axis=1), axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    new &= (every != home[:, None]) & (np.bitwise_count(every ^ halves[:, None]) <= 2)
    where = np.nonzero(new)
    return where[0], every[where]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (at, the anchor; fp; home) of each fingerprint in both halves; an anchor holds its half's number in bit 32."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 20_000):
            some = fps[at : at + 20_000]
            for side in (0, 1):
                halves = (some >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                i, near = anchors_within(halves)
                anchor = np.concatenate([homes(halves), near]).astype(np.int64) | side << 32
                member = np.concatenate([some, some[i]]).view(np.int64)
                is_home = np.arange(len(anchor)) < len(some)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(member), pa.array(is_home)], names=["at", "fp", "home"])


def spanning(home: np.ndarray, near: np.ndarray, threshold: int = THRESHOLD) -> tuple[list[int], list[int]]:
    """Ends of edges that span the links of each home to any member; each member is searched for once.

    A dense group shrinks fast as found members leave the search; a group without links costs its pairs.
    """
    a, b = [], []
    while len(home):
        stack, home = [(home[0], True)], home[1:]
        while stack:
            x, is_home = stack.pop()
            linked = np.bitwise_count(home ^ x) <= threshold
            found, home = home[linked], home[~linked]
            stack += [(y, True) for y in found]
            if is_home and len(near):
                linked = np.bitwise_count(near ^ x) <= threshold
                more, near = near[linked], near[~linked]
                stack += [(y, False) for y in more]
                found = np.concatenate([found, more])
            a += [x] * len(found)
            b += found.tolist()
    return a, b


LINKS = "a long, b long"


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows (at, fp, home) sorted by at."""
    kept: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

    def groups(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, fps, home = columns
        if not len(at):
            return
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sizes = np.diff(np.append(starts, len(at)))
        some = (sizes > 1) & (np.add.reduceat(home.astype(np.int64), starts) > 0)
        a, b = [], []
        for first, n in zip(starts[some].tolist(), sizes[some].tolist()):
            part, is_home = fps[first : first + n].view(np.uint64), home[first : first + n]
            more = spanning(part[is_home], part[~is_home])
            a += more[0]
            b += more[1]
        yield _links(a, b)

    for batch in batches:
        if batch.num_rows:
            columns = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            last = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last group may go on
            yield from groups([c[:last] for c in columns])
            kept = [c[last:] for c in columns]
    yield from groups(kept)


def _compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the two cells of a pair; rows (pair, fp, home) sorted by pair, at most two cells in each."""
    at, fps, home = None, [], []

    def result() -> pa.RecordBatch:
        part, is_home = np.array(fps, np.int64).view(np.uint64), np.array(home, bool)
        return _links(*spanning(part[is_home], part[~is_home]))

    for batch in batches:
        for pair, fp, is_home in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if pair != at:
                if fps:
                    yield result()
                at, fps, home = pair, [], []
            fps.append(fp)
            home.append(is_home)
    if fps:
        yield result()


def _by_size(members: DataFrame, cell: int) -> tuple[DataFrame, DataFrame | None]:
    """(small, large): rows (at, fp, home) of groups that fit one comparison, and those of others (None where there are none).

    Groups without a home have no links to find. Counts are combined before they are shuffled.
    """
    sizes = members.groupBy("at").agg(F.count("*").alias("n"), F.max("home").alias("any"))
    large = written(sizes.filter(F.col("any") & (F.col("n") > cell)).select("at", "n").coalesce(few(members.sparkSession)), "simhash-crowded")
    if large.isEmpty():
        return members, None
    return members.join(large.select("at"), "at", "left_anti"), members.join(large, "at")


def _edges(members: DataFrame, n: int) -> DataFrame:
    return members.select("at", "fp", "home").repartition(n, "at").sortWithinPartitions("at").mapInArrow(_compare, LINKS)


def link_edges(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect what links at ``THRESHOLD`` bits connects, of the distinct ``fp`` of a frame."""
    spark = fps.sparkSession
    tune(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = fps.mapInArrow(_placed, "at long, fp long, home boolean")
    small, crowded = _by_size(placed, cell)
    edges = _edges(small, n)
    if crowded is not None:
        # three bits at most differ in the half that isn't the anchor's: one of its four bytes is the same
        other = F.when(F.shiftright("at", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
        byte = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("byte")
        cut = crowded.select("at", "fp", "home", other.alias("other"), byte).select(
            (F.col("at") * 1024 + F.col("byte") * 256 + F.expr("shiftright(other, 8 * byte) & 255")).alias("at"), "fp", "home")
        small, crowded = _by_size(cut, cell)
        edges = edges.unionAll(_edges(small, n))
    if crowded is not None:
        cells = crowded.withColumn("cells", F.ceil(F.col("n") / F.lit(cell / 2)).cast("int"))
        own = cells.withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
        pairs = own.select("fp", "home", "at", "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")).select(
            F.concat_ws(":", "at", F.least("cell", "other"), F.greatest("cell", "other")).alias("pair"), "fp", "home")
        edges = edges.unionAll(pairs.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(_compare_cells, LINKS))
    return edges


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, cell: int = CELL) -> DataFrame:
    """(key, fingerprint, component_id, fp) of every row; component_id is the smallest key that links reach."""
    known = written(fingerprints(df, key, text, width), "simhash-fingerprints")
    of_fp = known.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    spark = df.sparkSession
    edges = link_edges(of_fp.select("fp"), cell)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")  # rows of numbers, compared in the first step here
    roots = connected_components(edges)
    tune(spark)
    named = of_fp.join(roots.withColumnRenamed("node", "fp"), "fp")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    of_fp = of_fp.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    of_fp = written(of_fp.coalesce(few(spark)), "simhash-components")
    # Fingerprints with more than one in FREQUENT of all rows a partition: FREQUENT a partition at most, so they are broadcast.
    often = FREQUENT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = of_fp.filter(F.col("n") > known.count() // often + 1).select("fp", F.col("component_id").alias("found"), F.lit(True).alias("often"))
    marked = known.join(F.broadcast(frequent), "fp", "left")
    rest = marked.filter("often is null").select(key, "fp").join(of_fp.select("fp", "component_id"), "fp").select(key, "fp", "component_id")
    every = marked.filter("often").select(key, "fp", F.col("found").alias("component_id")).unionAll(rest)
    return every.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with all its columns, with one row of each component: the smallest key, and of its rows the first in the scan."""
    rows, row = numbered(df, "simhash-rows")
    of_row = near_duplicates(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), "row", "text", width).select("row", "component_id")
    keyed = of_row.join(rows.select(F.col(row).alias("row"), F.col(key).alias("key")), "row")
    first = F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first")
    stay = keyed.groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    return rows.join(stay, row, "left_semi").drop(row)
