"""Sharding by a uniform shuffle with exact shard sizes (law ``rows``: counts at most one apart).

1. Count the rows of every input partition (no column is read).
2. Draw the communication matrix: how many rows of partition p go to shard s, exactly distributed as under a uniform
   shuffle. Row by row this is a multivariate hypergeometric draw from what room the shards still have, so the
   columns add up to the shard sizes exactly.
3. Permute locally: a partition's multiset of shard numbers (given by its row of the matrix) is shuffled and dealt to
   its rows in order. No row moves for this.
4. Exchange rows by shard and permute again: each row carries a random 62-bit key, a mix of its number; its
   slot is its place by that key within its shard. A shard is cut into ranges of keys, so no task holds a whole
   shard, and the offsets of ranges come from their counts.

Rows are written once with their numbers (partition and place), and all of the above follows from these and the seed: a
lost executor's tasks, or files that are read in other pieces than before, draw the same again.

Results: nulls and empty texts are rows as any others, equal texts are not kept together (a group of a third of all
rows fits no shard), repeated rows get slots of their own, an empty table gives no rows; extra columns come along under any names but shard and slot, which raise an error. The driver holds one count
for each partition and shard, and one for each range; nothing else grows there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import numbered, tune, written

#: Rows that one range of a shard holds on average, at most; and ranges a shard has at least.
RANGE_ROWS, LEAST_RANGES = 250_000, 8
#: numpy's own sampler takes populations below this.
NUMPY_LIMIT = 10**9
_KEY_BITS = 62


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good; for populations of any size.

    Above numpy's limit: inversion over the ratio recurrence of the mass function, outwards from its mode over all
    values within 14 standard deviations, which leaves out less than 1e-40 of the mass.
    """
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(14 * (draws * share * (1 - share) * (total - draws) / max(1, total - 1)) ** 0.5) + 30
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rising = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    falling = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    mass = np.cumsum(np.concatenate([falling[::-1], [1.0], rising]))
    return mode - len(down) + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards take what is left over."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Counts [partition, shard] of a uniform shuffle of all rows into shards of exactly these sizes."""
    rng, room = np.random.default_rng([seed, 0]), list(sizes)
    out = np.zeros((len(partition_rows), len(sizes)), np.int64)
    for p, n in enumerate(partition_rows):
        rest, left = sum(room), n
        for s, r in enumerate(room):
            if not left:
                break
            rest -= r
            out[p, s] = k = hypergeometric(rng, r, rest, left) if rest and r else min(left, r)
            left -= k
            room[s] -= int(k)
    return out


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers (the finisher of SplitMix64), so that keys need no order of drawing."""
    x = x.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def deal(rows: DataFrame, row: str, shards: int, seed: int = 11) -> DataFrame:
    """(row, shard, key) for each row: its number, its shard and its random key.

    ``row`` holds the partition that a row was written from above bit 33 and its place there below, as numbers of
    written rows do. However the files are read, a row is dealt by these two alone.
    """
    tune(rows.sparkSession)
    numbers = rows.select(F.col(row).alias("row"))
    counts = {r["p"]: r["n"] for r in numbers.groupBy(F.shiftright("row", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    n_partitions = 1 + max(counts, default=-1)
    matrix = communication_matrix([counts.get(p, 0) for p in range(n_partitions)], shard_sizes(sum(counts.values()), shards), seed)
    shared = rows.sparkSession.sparkContext.broadcast(matrix)  # one number for each partition and shard

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, partition = None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            of, shard = numbers >> 33, np.empty(len(numbers), np.int32)
            for p in np.unique(of).tolist():
                if partition != p:
                    partition = p
                    rng = np.random.default_rng([seed, 1, partition])
                    dealt = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), shared.value[partition]))
                shard[of == p] = dealt[numbers[of == p] & ((1 << 33) - 1)]
            keys = _mixed(numbers, seed) >> np.uint64(64 - _KEY_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard), pa.array(keys.view(np.int64))], names=["row", "shard", "key"])

    return numbers.mapInArrow(place, "row long, shard int, key long")


def shuffle_shards(df: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """``df`` with shard (0 to ``shards`` - 1) and slot (0 to the shard's size - 1, gapless), a uniform shuffle."""
    if {n.lower() for n in df.columns} & {"shard", "slot"}:
        raise ValueError("shard and slot must be free names")
    df, name = numbered(df, "shuffle-rows")
    dealt = written(deal(df, name, shards, seed), "shuffle-deal")  # 20 bytes a row
    rows = dealt.count()
    ranges = max(LEAST_RANGES, -(-rows // (shards * RANGE_ROWS)))
    # A range is the leading part of the key: sorting by range, then by key, is sorting by key.
    width = -(-(1 << _KEY_BITS) // ranges)
    dealt = dealt.select("row", "shard", "key", F.expr(f"key div {width}L").cast("int").alias("range"))
    counted = {(r["shard"], r["range"]): r["n"] for r in dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()}
    offsets = []
    for s in range(shards):
        at = 0
        for g in range(ranges):
            offsets.append((s, g, at))
            at += counted.get((s, g), 0)
    offset = df.sparkSession.createDataFrame(offsets, "shard int, range int, offset long")  # one row for each range
    order = "row_number() over (partition by shard, range order by key, row) - 1 + offset"
    placed = dealt.join(offset, ["shard", "range"]).select(F.col("row").alias(name), "shard", F.expr(order).alias("slot"))
    return df.join(placed, name).drop(name)
