"""Removal of repeated passages: every byte covered by a 200-byte string that also starts anywhere else.

Suffix arrays over a whole corpus, or each shard's against every other shard's, grow with the square of the shards. So
strings are first dealt by content, such that equal strings meet in one shard:

1. Windows. Each 200-byte window of a text has a minimizer, its least hashed 32-byte gram. Successive windows that share
   it form a run of at most ``MAX_WINDOWS`` windows; equal windows have equal minimizers, wherever they stand. A run is
   one row: minimizer, 128-bit BLAKE2b digest of its bytes, place.
2. Runs whose minimizer occurs once, at one place, are done: nothing in them repeats. A minimizer whose runs are all the same bytes
   is done as well: all their windows repeat. (Counts and extremes of digests are aggregated before the shuffle.)
3. What is left are minimizers with several texts around them, at the ends of repeated passages. One run of each of its
   different texts goes to a shard by minimizer; runs whose digest occurs again repeat whole, as in 2.
4. Shards. The runs' bytes, each with an end mark of its own, make the shard's text. Its suffix array is built by
   Larsson-Sadakane refinement: prefix doubling in which only groups that aren't sorted yet are sorted again.
   Kasai's algorithm gives the common prefixes of neighbours, advancing in all runs at once. Neighbours with 200 bytes
   in common are repeated windows. The runs of one minimizer may fill several shards; these are merged pairwise by binary
   search of the windows of one in the suffix array of the other, all of them at once.
5. A minimizer with over ``HOT`` different texts around it (a line that a third of all documents share) would need too
   many such merges: its windows are counted by 128-bit digest instead, aggregated before the shuffle.
6. Each document's repeated windows are merged into spans and cut out. The exchange of texts by row serves steps 4 and 6.

Results: a null text is empty, texts under 200 bytes lose nothing, matches never cross texts, both copies of a repeated
passage go, as do rows that repeat a text of 200 bytes or more. Overlapping repeats within one text count. Strings with
equal 128-bit BLAKE2b digests count as equal bytes (steps 2, 3 and 5): by chance that is wrong with a probability
under 1e-12 among 10**13 runs, and no text is known for which it is; ``verify`` compares them. Minimizers only bring
strings together.
Texts of any length are cut into pieces of ``PIECE`` bytes for step 1, with windows overlapping the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import few, map_rows, numbered, tune, written

LENGTH, GRAM = 200, 32
#: Grams of a window, and windows of a run at most.
GRAMS = MAX_WINDOWS = LENGTH - GRAM + 1
PIECE = 1 << 19
SHARD_BYTES, HOT = 1 << 20, 12_000

_POSITION = np.uint64((1 << 20) - 1)
_numbers = np.random.default_rng(20240607)
_BYTE = _numbers.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LEFT = _numbers.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_RIGHT = _numbers.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on; as many as fit."""
    x, level, half = _BYTE[data], 0, 1
    while half < GRAM:
        left = x[:-half] * _LEFT[level]
        x = np.add(left, x[half:] * _RIGHT[level], out=left)
        level, half = level + 1, 2 * half
    x ^= x >> np.uint64(31)
    x *= _LEFT[9]
    return x


def digests_of(data: bytes, starts: list[int], sizes: list[int]) -> np.ndarray:
    """(n, 2) longs: the digests of the strings of these sizes from each start on."""
    found = b"".join([hashlib.blake2b(data[a : a + n], digest_size=16).digest() for a, n in zip(starts, sizes)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def window_minima(grams: np.ndarray) -> np.ndarray:
    """For each window the least gram hash, its low 20 bits replaced by the gram's place (the first of equal ones)."""
    m = grams & ~_POSITION | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < GRAMS:
        rest = GRAMS - width
        m = np.minimum(m[:-rest], m[rest:])
    return m


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimizer, digests, first window, windows, again) of the runs in texts that lie one after the other, up to ``ends``.

    ``again`` is true where the minimizer comes at several places of a run, whose windows may then equal each other.
    """
    if len(data) < LENGTH:
        return np.empty(0, np.uint64), np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    grams = gram_hashes(data)
    least = window_minima(grams)
    inside = np.ones(len(least), bool)
    for end in ends:
        inside[max(0, end - LENGTH + 1) : end] = False
    value = least >> np.uint64(20)
    new = np.empty(len(least), bool)
    new[0] = inside[0]
    new[1:] = inside[1:] & (~inside[:-1] | (value[1:] != value[:-1]))
    start = np.flatnonzero(new)
    closed = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    count = closed - start + 1
    pieces = -(-count // MAX_WINDOWS)
    if len(pieces) and pieces.max() > 1:  # a gram that comes again and again holds its minimum beyond one window
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, left = np.repeat(start, pieces) + nth * MAX_WINDOWS, np.repeat(count, pieces) - nth * MAX_WINDOWS
        count = np.minimum(left, MAX_WINDOWS)
    minimizer = grams[(least[start] & _POSITION).astype(np.int64)]
    digests = digests_of(data.tobytes(), start.tolist(), (count + LENGTH - 1).tolist())
    return minimizer, digests, start, count, least[start] != least[start + count - 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


RUNS = "f long, h1 long, h2 long, row long, a int, n int, again boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of every (row, text), texts gathered to pieces of up to PIECE bytes."""
    held: list[tuple[int, int, bytes]] = []  # row, offset of the piece in its text, bytes
    size = 0

    def flush() -> pa.RecordBatch:
        sizes = np.array([len(p[2]) for p in held])
        ends = np.cumsum(sizes)
        f, h, start, count, again = runs_of(np.frombuffer(b"".join(p[2] for p in held), np.uint8), ends)
        of = np.searchsorted(ends, start, "right")
        row, offset = np.array([p[0] for p in held], np.int64), np.array([p[1] for p in held], np.int64)
        a = start - (ends - sizes)[of] + offset[of]
        columns = [_signed(f), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(row[of]), pa.array(a.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)]
        return pa.RecordBatch.from_arrays(columns, names=["f", "h1", "h2", "row", "a", "n", "again"])

    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode("utf-8")
            for at in range(0, max(1, len(data) - LENGTH + 1), PIECE - LENGTH + 1):
                piece = data[at : at + PIECE]
                if len(piece) < LENGTH:
                    continue
                if size + len(piece) > PIECE and held:
                    yield flush()
                    held, size = [], 0
                held.append((row, at, piece))
                size += len(piece)
    if held:
        yield flush()


# ---- suffix arrays ----

_PACKED = 7


class Shard:
    """Suffix array of some texts, each closed by an end mark that differs from all others (earlier ones are less)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.sizes = sizes
        n = int(sizes.sum()) + len(texts)
        self.symbols = np.zeros(n + _PACKED, np.int64)  # bytes count from 1, an end mark is 0
        joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        self.symbols[:n] = joined.astype(np.int64) + 1
        self.symbols[self.starts + sizes] = 0
        self.n = n
        self.order, self.rank = self._sorted(int(sizes.max(initial=0)) + 1)

    def _sorted(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Larsson-Sadakane refinement: the sorted suffixes and each suffix's place.

        A round sorts the groups that aren't yet by the ranks behind them; two ranks at once (thrice the depth) where
        three of them fit one integer, else one (twice the depth).
        """
        n = self.n
        key, closed = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(_PACKED):
            symbol = np.where(closed, 0, self.symbols[j : j + n])
            key = key << 9 | symbol
            closed |= symbol == 0
        self.packed = key
        order = np.argsort(key, kind="stable")
        # suffixes that reach their end mark differ from all others; equal keys stand in order of their marks
        in_order = key[order]
        new = closed[order]
        new[0] = True
        new[1:] |= in_order[1:] != in_order[:-1]
        rank = np.empty(n, np.int64)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        rank[order] = np.repeat(first, sizes)
        h, bits = _PACKED, n.bit_length()
        unsorted = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        while len(unsorted) and h < depth:
            some = order[unsorted]
            key = rank[some] << bits | rank[np.minimum(some + h, n - 1)]
            if 3 * bits < 64:
                key = key << bits | rank[np.minimum(some + 2 * h, n - 1)]
                h *= 3
            else:
                h *= 2
            by = np.argsort(key)
            some, key = some[by], key[by]
            order[unsorted] = some
            new = np.ones(len(some), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(some)))
            rank[some] = np.repeat(unsorted[first], sizes)
            unsorted = unsorted[np.repeat(sizes, sizes) > 1]
        return order, rank

    def common_prefixes(self) -> np.ndarray:
        """Kasai: for each place in the suffix array the bytes in common with the place before; all texts advance at once.

        Prefixes grow by whole packed keys while these are equal and hold no end mark, then by single bytes.
        """
        n = self.n
        whole = np.append(np.where(np.repeat(self.sizes + 1, self.sizes + 1) - self._offsets() > _PACKED, self.packed, -np.arange(1, n + 1)), 0)
        lcp, h, live = np.zeros(n, np.int64), np.zeros(len(self.starts), np.int64), np.arange(len(self.starts))
        for t in range(int(self.sizes.max(initial=0))):
            live = live[self.sizes[live] > t]
            i = self.starts[live] + t
            place = self.rank[i]
            reach = np.where(place > 0, np.maximum(h[live] - 1, 0), 0)
            j = self.order[np.maximum(place - 1, 0)]
            for compared, step in ((whole, _PACKED), (self.symbols, 1)):
                going = np.flatnonzero(place > 0)
                at, to = i[going] + reach[going], j[going] + reach[going]
                while len(going):
                    x = compared[np.minimum(at, n - 1)]
                    same = (x == compared[np.minimum(to, n - 1)]) & (x > 0) & (at != to)
                    going, at, to = going[same], at[same] + step, to[same] + step
                    reach[going] += step
            h[live] = reach
            lcp[place] = reach
        return lcp

    def _offsets(self) -> np.ndarray:
        """Each position's distance from the start of its text."""
        return np.arange(self.n) - np.repeat(self.starts, self.sizes + 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, new): all windows in suffix order, and whether each differs from the one before."""
        full = np.repeat(self.sizes + 1, self.sizes + 1) - self._offsets() > LENGTH
        places = np.flatnonzero(full[self.order])
        return self.order[places], self.common_prefixes()[places] < LENGTH


#: Windows that are searched for at once.
SEARCHED = 1 << 15


def compared(x: np.ndarray, at: np.ndarray, y: np.ndarray, to: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the windows of ``x`` at some positions are less than, equal to or above those of ``y`` at others.

    ``x`` and ``y`` are ``Sorted.words``.
    """
    out, live = np.zeros(len(at), np.int8), np.arange(len(at))
    for k in range(0, LENGTH, 8):
        a, b = x[at[live] + k], y[to[live] + k]
        out[live] = (a > b).astype(np.int8) - (a < b)
        live = live[a == b]
        if not len(live):
            break
    return out


class Sorted:
    """A shard as others see it: its windows in order, which of the different ones each is, and whether these repeat.

    ``words`` are the eight bytes from each position on, as numbers that compare as the bytes do.
    """

    def __init__(self, texts: list[bytes]):
        windows, new = Shard(texts).windows()
        data = np.frombuffer(b"\0".join([*texts, bytes(8)]), np.uint8)
        self.words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">u8").ravel().astype(np.uint64)
        self.windows, self.which = windows.astype(np.int32), (np.cumsum(new) - 1).astype(np.int32)
        self.different = self.windows[new]
        self.first = self.words[self.different]
        self.repeats = np.bincount(self.which, minlength=len(self.different)) > 1

    def places(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, place): which windows at some positions of a shard with these ``words`` are among the different ones here, and where.

        Binary search, for all windows at once: first by their first eight bytes, then by the others among those that share these.
        """
        keys = words[at]
        low, high = np.searchsorted(self.first, keys, "left"), np.searchsorted(self.first, keys, "right")
        end, met = high.copy(), np.flatnonzero(low < high)
        live = met
        while len(live):
            middle = (low[live] + high[live]) // 2
            up = compared(self.words, self.different[middle], words, at[live]) < 0
            low[live] = np.where(up, middle + 1, low[live])
            high[live] = np.where(up, high[live], middle)
            live = live[low[live] < high[live]]
        met = met[low[met] < end[met]]
        met = met[compared(self.words, self.different[low[met]], words, at[met]) == 0]
        return met, low[met]

    def repeated(self) -> np.ndarray:
        """True for the positions of windows that repeat."""
        out = np.zeros(len(self.words), bool)
        out[self.windows[self.repeats[self.which]]] = True
        return out


def repeated_windows(texts: list[bytes], shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each text the starts of its windows that start anywhere else in ``texts`` as well.

    Texts fill shards in turn; shards are merged by binary search of the different windows of one in those of the other.
    Of a shard only its bytes and its windows in order are held while others are built.
    """
    shards: list[list[int]] = [[]]
    size = 0
    for k, text in enumerate(texts):
        if size + len(text) > shard_bytes and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(text)
    shards = [members for members in shards if members]
    built = [Sorted([texts[k] for k in members]) for members in shards]
    for x in range(len(built)):
        for y in range(x + 1, len(built)):
            for i in range(0, len(built[x].different), SEARCHED):
                same, place = built[y].places(built[x].words, built[x].different[i : i + SEARCHED])
                built[x].repeats[i + same] = True
                built[y].repeats[place] = True
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    for members, shard in zip(shards, built):
        flag, at = shard.repeated(), 0
        for k in members:
            out[k] = np.flatnonzero(flag[at : at + len(texts[k])])
            at += len(texts[k]) + 1
    return out


SPANS = "row long, a int, n int"


def _spans(rows: list[int], firsts: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    """Successive windows as (row, first, how many)."""
    out: tuple[list, list, list] = ([], [], [])
    for row, first, at in zip(rows, firsts, found):
        if len(at):
            begin = np.flatnonzero(np.append(True, np.diff(at) > 1))
            out[0].extend([row] * len(begin))
            out[1].extend((at[begin] + first).tolist())
            out[2].extend(np.diff(np.append(begin, len(at))).tolist())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32()))], names=["row", "a", "n"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows among (f, row, a, bytes) sorted by f; minimizers share a shard while it has room."""
    held: list[tuple[int, int, int, bytes]] = []
    size, f_start = 0, 0  # f_start: where the last minimizer begins in held

    def result(some: list) -> pa.RecordBatch:
        return _spans([x[1] for x in some], [x[2] for x in some], repeated_windows([x[3] for x in some]))

    for batch in batches:
        for item in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and item[0] != held[-1][0]:
                if size >= SHARD_BYTES:
                    yield result(held)
                    held, size = [], 0
                f_start = len(held)
            elif held and size >= SHARD_BYTES and f_start:
                yield result(held[:f_start])
                held, f_start = held[f_start:], 0
                size = sum(len(x[3]) for x in held)
            held.append(item)
            size += len(item[3])
    if held:
        yield result(held)


def _window_digests(columns: dict) -> dict:
    """128-bit digest, row and place of each window of (row, a, bytes)."""
    out: dict[str, list] = {"d1": [], "d2": [], "row": [], "a": []}
    for row, a, text in zip(*(columns[n].to_pylist() for n in ("row", "a", "bytes"))):
        n = len(text) - LENGTH + 1
        digests = digests_of(text, range(n), [LENGTH] * n)
        out["d1"].append(digests[:, 0])
        out["d2"].append(digests[:, 1])
        out["row"].append(np.full(n, row, np.int64))
        out["a"].append(np.arange(a, a + n))
    return {n: np.concatenate(x) if x else [] for n, x in out.items()}


#: Windows that are merged at once are those that begin in so many bytes of a text.
MERGED = 1 << 14


def _merged(columns: dict) -> dict:
    """Successive windows of (row, starts) as (row, first, how many)."""
    out: dict[str, list] = {"row": [], "a": [], "n": []}
    for row, starts in zip(columns["row"].to_pylist(), columns["starts"]):
        at = np.unique(starts.values.to_numpy())
        begin = np.flatnonzero(np.append(True, np.diff(at) > 1))
        out["row"] += [row] * len(begin)
        out["a"] += at[begin].tolist()
        out["n"] += np.diff(np.append(begin, len(at))).tolist()
    return out


def _cut_contexts(columns: dict) -> dict:
    """Bytes of each run of (row, text, runs)."""
    out: dict[str, list] = {"f": [], "row": [], "a": [], "hot": [], "bytes": []}
    for row, text, runs in zip(columns["row"].to_pylist(), columns["text"], columns["runs"].to_pylist()):
        data = text.as_py().encode("utf-8")
        for r in runs:
            out["f"].append(r["f"])
            out["row"].append(row)
            out["a"].append(r["a"])
            out["hot"].append(r["hot"])
            out["bytes"].append(data[r["a"] : r["a"] + r["n"] + LENGTH - 1])
    return out


def _cut_runs(columns: dict) -> dict:
    """Digests and bytes of each run of (text, runs)."""
    out: dict[str, list] = {"h1": [], "h2": [], "bytes": []}
    for text, runs in zip(columns["text"], columns["runs"].to_pylist()):
        data = text.as_py().encode("utf-8")
        for r in runs:
            out["h1"].append(r["h1"])
            out["h2"].append(r["h2"])
            out["bytes"].append(data[r["a"] : r["a"] + r["n"] + LENGTH - 1])
    return out


def collisions(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(h1, h2) of ``runs`` (h1, h2, row, a, n) whose bytes differ though their digests are equal.

    Equal bytes are folded before they are shuffled; of each digest its least and its greatest bytes are compared.
    """
    wanted = runs.groupBy("row").agg(F.collect_list(F.struct("h1", "h2", "a", "n")).alias("runs"))  # of one document
    cut = map_rows(texts.join(wanted, "row").select("text", "runs"), _cut_runs, "h1 long, h2 long, bytes binary")
    return cut.groupBy("h1", "h2").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).filter("least <> most").select("h1", "h2")


def _all_equal(found: DataFrame) -> None:
    if (one := found.first()) is not None:
        raise ValueError(f"different strings share the digest {one['h1']}, {one['h2']}")


def repeated_spans(texts: DataFrame, hot: int = HOT, verify: bool = False) -> DataFrame:
    """(row, a, n): n successive repeated windows from byte a on. ``texts`` has row, key and text.

    With ``verify`` the bytes of all strings with equal digests are compared, and an error is raised where they differ.

    The join that fetches the runs' bytes keeps all of ``texts`` so that its exchange by row is the very one that the
    join with the result needs: Spark then does it once.
    """
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = written(texts.select("row", "text").mapInArrow(_runs, RUNS), "suffix-runs")
    of_f = runs.groupBy("f").agg(
        F.count("*").alias("count"), *[g(h).alias(f"{n}_{h}") for h in ("h1", "h2") for n, g in (("least", F.min), ("most", F.max))], F.max("again").alias("within"))
    of_f = of_f.filter("count > 1 or within").select("f", F.expr("count = 1 or least_h1 <> most_h1 or least_h2 <> most_h2").alias("several"))
    # Aggregates are written before they are joined: with an exchange on both sides Spark may split a very frequent key.
    some = few(spark)
    of_f = written(of_f.coalesce(some), "suffix-minimizers")
    again = written(runs.drop("again").join(of_f, "f"), "suffix-repeats")
    if verify:
        _all_equal(collisions(texts, again))
    same = again.filter("not several").select("row", "a", "n")
    several = again.filter("several")
    of_h = several.groupBy("f", "h1", "h2").agg(F.count("*").alias("count"), F.min(F.struct("row", "a", "n")).alias("one"))
    of_h = written(of_h.coalesce(some), "suffix-surroundings")
    same = same.unionAll(several.join(of_h.filter("count > 1").select("f", "h1", "h2"), ["f", "h1", "h2"]).select("row", "a", "n"))
    ones = of_h.select("f", "one.*")
    crowded = ones.groupBy("f").agg(F.count("*").alias("count")).filter(F.col("count") > hot).select("f", F.lit(True).alias("hot"))
    crowded = written(crowded.coalesce(some), "suffix-crowded")
    ones = ones.join(crowded, "f", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = ones.groupBy("row").agg(F.collect_list(F.struct("f", "a", "n", "hot")).alias("runs"))  # of one document
    contexts = map_rows(texts.join(wanted, "row").select("row", "key", "text", "runs"), _cut_contexts, "f long, row long, a int, hot boolean, bytes binary")
    sharded = contexts.filter("not hot").select("f", "row", "a", "bytes").repartition(partitions, "f").sortWithinPartitions("f")
    found = sharded.mapInArrow(_shards, SPANS)
    if crowded.isEmpty():
        return same.unionAll(found)
    windows = map_rows(contexts.filter("hot").select("row", "a", "bytes"), _window_digests, "d1 long, d2 long, row long, a int")
    if verify:
        _all_equal(collisions(texts, windows.select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), "row", "a", F.lit(1).alias("n"))))
    counted = windows.groupBy("d1", "d2").agg(F.count("*").alias("count")).filter("count > 1").select("d1", "d2")
    counted = written(counted.coalesce(some), "suffix-windows")
    repeated = windows.join(counted, ["d1", "d2"]).groupBy("row", F.expr(f"a div {MERGED}")).agg(F.collect_list("a").alias("starts"))  # MERGED starts at most
    return same.unionAll(found).unionAll(map_rows(repeated.select("row", "starts"), _merged, SPANS))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows cover, from (first window, windows)."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - 1 + LENGTH)
        else:
            out.append([a, a + n - 1 + LENGTH])
    return [(a, b) for a, b in out]


def _kept(columns: dict) -> dict:
    out: dict[str, list] = {"key": columns["key"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for text, spans in zip(columns["text"], columns["spans"].to_pylist()):
        data = (text.as_py() or "").encode("utf-8")
        ranges = covered([(s["a"], s["n"]) for s in spans or []])
        edges = [0, *(x for r in ranges for x in r), len(data)]
        out["n_bytes"].append(len(data))
        out["n_removed"].append(sum(b - a for a, b in ranges))
        out["n_spans"].append(len(ranges))
        out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
    return out


def _digested(columns: dict) -> dict:
    out = _kept(columns)
    return out | {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in out.pop("kept")]}


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, hot: int = HOT, verify: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; kept are the bytes left over, or with ``digest`` kept_sha256 of them.

    ``verify`` compares strings with equal digests byte by byte, at the cost of shuffling the bytes of every repeated run.
    """
    spark = df.sparkSession
    tune(spark)
    rows, row = numbered(df.select(df[key].alias("key"), df[text].alias("text")), "suffix-texts")
    # The filter says of what is read back what the inner join would add: both joins below then share one exchange of texts.
    rows = rows.select(F.col(row).alias("row"), "key", "text").filter("row is not null")
    flags = repeated_spans(rows, hot, verify).groupBy("row").agg(F.collect_list(F.struct("a", "n")).alias("spans"))  # of one document
    kind, last = dict(df.dtypes)[key], "kept_sha256 string" if digest else "kept binary"
    whole = rows.join(flags, "row", "left").select("row", "key", "text", "spans")
    return map_rows(whole, _digested if digest else _kept, f"key {kind}, n_bytes long, n_removed long, n_spans long, {last}").withColumnRenamed("key", key)
