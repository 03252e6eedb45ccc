"""Exact deduplication by complete content: Grace hash partitioning and an open-addressing table for each bucket.

Texts are equal when they are identical after every ASCII white-space character is deleted. Of equal texts the row
with the most code points in its original text stays, then the one with the smallest key.

1. Each input task folds its own equal texts first (an open-addressing table of bounded size, flushed when full),
   so that a text held by a third of all rows leaves a task once, not once a row.
2. Grace partitioning: the bytes of distinct digests are summed by digest prefix. A prefix with more bytes than fit
   one table is split again by its next bits, recursively, until every bucket fits or holds a single digest. The
   plan is made on counts, so each record is spilled once, straight into its final bucket: Spark's shuffle files are
   the spill files, which outlive the loss of an executor as Spark rebuilds them.
3. Each bucket's records meet in one open-addressing table (linear probing) that compares complete contents; the
   digest only picks the slot.
4. Rows find their group by digest in a join that Spark may split at run time where one group is very large.

Two different texts with one SHA-256 would be told apart by step 3, which then fails instead of guessing.

Results: a null text counts as empty. Ties go to the smallest key; a null key comes after all others, and rows that
repeat a key as well keep exactly one of them, the first as they were written. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import SPACE_BYTES, WHOLE_NUMBERS, map_rows, numbered, tune, whole_key, written

#: Bytes of distinct content that one table holds.
TABLE_BYTES = 32 << 20
#: Bytes of content, about, that a partition holds at most: many tables, one after the other.
PARTITION_BYTES = 512 << 20
#: Digest bits that each recursion adds.
MORE_BITS = 4


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text without ASCII white space."""
    return (text or "").encode("utf-8").translate(None, SPACE_BYTES)


class ContentTable:
    """Open addressing with linear probing over complete contents; ``entry`` gives a content's number."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.bytes = 0

    def entry(self, digest: bytes, content: bytes) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        i = int.from_bytes(digest[-8:], "little") & mask
        while (k := slots[i]) >= 0:
            if self.digests[k] == digest:
                if self.contents[k] != content:
                    raise ValueError(f"two texts share the digest {digest.hex()}")
                return k
            i = (i + 1) & mask
        slots[i] = k = len(self.contents)
        self.contents.append(content)
        self.digests.append(digest)
        self.bytes += len(content) + 200
        if 3 * (k + 1) > 2 * len(slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = slots = [-1] * (4 * len(self.slots))
        for k, digest in enumerate(self.digests):
            i = int.from_bytes(digest[-8:], "little") & (len(slots) - 1)
            while slots[i] >= 0:
                i = (i + 1) & (len(slots) - 1)
            slots[i] = k


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, key, row) the one that stays."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]))


FOLDED = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("n", pa.int64()), ("n_chars", pa.int64()), ("key", pa.int64()), ("row", pa.int64())])


def _fold(rows: Iterator[tuple], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Equal contents among (digest, content, n, best) folded, in tables of at most ``table_bytes``."""
    table, counts, best = ContentTable(), [], []

    def flush() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(counts), 500):
            some = slice(i, i + 500)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([table.digests[some], table.contents[some], counts[some], *(zip(*best[some]))], FOLDED)], schema=FOLDED)

    for digest, content, n, candidate in rows:
        k = table.entry(digest, content)
        if k == len(counts):
            counts.append(n)
            best.append(candidate)
        else:
            counts[k] += n
            best[k] = better(best[k], candidate)
        if table.bytes > table_bytes:
            yield from flush()
            table, counts, best = ContentTable(), [], []
    yield from flush()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                content = normalised(text)
                yield hashlib.sha256(content).digest(), content, 1, (len(text), key, row)

    yield from _fold(rows(), TABLE_BYTES)


GROUPS = pa.schema([("digest", pa.binary()), ("group_size", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64())])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a table lives for one bucket."""
    at, table, counts, best = None, ContentTable(), [], []

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([table.digests, counts, [b[1] for b in best], [b[2] for b in best]], GROUPS)], schema=GROUPS)

    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)).to_pylist() for c in ("bucket", "digest", "n", "n_chars", "key", "row")]
        contents = batch.column(names.index("content"))
        for i, (bucket, digest, n, *candidate) in enumerate(zip(*columns)):
            if bucket != at:
                if counts:
                    yield result()
                at, table, counts, best = bucket, ContentTable(), [], []
            k = table.entry(digest, contents[i].as_py())
            if k == len(counts):
                counts.append(n)
                best.append(tuple(candidate))
            else:
                counts[k] += n
                best[k] = better(best[k], tuple(candidate))
    if counts:
        yield result()


def _prefix(bits: int):
    """The first ``bits`` bits of a digest as a number (at most 60)."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 8)).substr(1, 15), 16, 10).cast("long"), 60 - bits)


def grace_plan(distinct: DataFrame, table_bytes: int) -> list[tuple[int, list[int]]]:
    """Levels (bits, prefixes too large for one table at that many bits) of the recursive partitioning.

    ``distinct`` has digest and bytes, one row a digest. The first level has about half a table for each prefix;
    only prefixes above ``table_bytes`` come to the driver, and digests spread evenly, so these are the few that hold
    very long texts. The last level has no large prefix left, or no bits.
    """
    total = distinct.agg(F.sum("bytes")).collect()[0][0] or 0
    bits, levels, rest = min(40, max(1, (2 * total // table_bytes).bit_length())), [], distinct
    while True:
        sums = rest.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        large = [r["prefix"] for r in sums.filter((F.col("b") > table_bytes) & (F.col("n") > 1)).collect()]
        levels.append((bits, large if bits + MORE_BITS <= 60 else []))
        if not levels[-1][1]:
            return levels
        rest = rest.filter(_prefix(bits).isin(large))
        bits += MORE_BITS


def bucket_of(levels: list[tuple[int, list[int]]]):
    """Bucket of a digest: its bits at the first level at which they aren't too large, and how many bits these are."""
    out = None
    for bits, large in reversed(levels):
        own = F.struct(F.lit(bits).alias("bits"), _prefix(bits).alias("prefix"))
        out = own if out is None else F.when(_prefix(bits).isin(large), out).otherwise(own)
    return out


def find_groups(df: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, groups): members are (key, row, n_chars, digest, bytes) of each row, groups (digest, group_size, keep_id, keep_row).

    ``row`` names a column of stored numbers of rows (they are read twice); without one, key and text are written with numbers.
    Keys of other types than whole numbers count as null.
    """
    tune(df.sparkSession)
    number = whole_key(df, key) if dict(df.dtypes)[key] in WHOLE_NUMBERS else F.lit(None).cast("long")
    rows = df.select(number.alias("key"), df[text].alias("text"), *([df[row].alias("row")] if row else []))
    if not row:
        rows, row = numbered(rows, "dedup-rows")
        rows = rows.withColumnRenamed(row, "row")

    def digests(columns: dict) -> dict:
        texts = [t.as_py() or "" for t in columns["text"]]
        contents = [normalised(t) for t in texts]
        return {"key": columns["key"], "row": columns["row"], "n_chars": [len(t) for t in texts], "digest": [hashlib.sha256(c).digest() for c in contents], "bytes": [len(c) + 200 for c in contents]}

    members = written(map_rows(rows, digests, "key long, row long, n_chars long, digest binary, bytes long"), "dedup-members")
    levels = grace_plan(members.groupBy("digest").agg(F.max("bytes").alias("bytes")), table_bytes)
    folded = rows.mapInArrow(_local, "digest binary, content binary, n long, n_chars long, key long, row long")
    # a task takes its buckets one after the other, so it may have many: partitions follow the bytes, not the buckets
    n = max((table_bytes << levels[0][0]) // PARTITION_BYTES, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucketed = folded.withColumn("_b", bucket_of(levels)).withColumn("bucket", F.concat_ws(":", "_b.bits", "_b.prefix")).drop("_b")
    spilled = bucketed.repartition(n, "bucket").sortWithinPartitions("bucket")
    return members, spilled.mapInArrow(_buckets, "digest binary, group_size long, keep_id long, keep_row long")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of ``df``: key, keep_id, group_size, kept and text_sha256. The key must be a whole number."""
    whole_key(df, key)
    members, groups = find_groups(df, key, text, table_bytes)
    joined = members.join(groups, "digest")
    return joined.select(
        F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``df`` with all its columns, whatever their names, without the rows that exact deduplication drops.

    Where the key isn't a whole number, of equal texts with the most code points the first row stays.
    """
    df, row = numbered(df, "dedup-rows")
    members, groups = find_groups(df, key, text, table_bytes, row)
    gone = members.join(groups, "digest").filter("row <> keep_row").select(F.col("row").alias(row))
    return df.join(gone, row, "left_anti").drop(row)
