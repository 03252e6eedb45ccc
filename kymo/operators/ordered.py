"""Order within recordings of any length: places and windows of rows, no recording in one task.

Rows are sorted by ranges of (recording, order), so one long recording lies in many tasks, and written once with their
places. What comes before a range is known from one small row for each recording and range. Windows over the last rows
then go by blocks of places, each with the rows before it that its first windows reach (a halo).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.session import stored

#: Rows of a block; at least eight times what a window reaches back.
BLOCK = 16384


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def earlier(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], counts: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``df``, written, with a column for each of ``counts``: how many rows before it in its recording fulfil that condition.

    Rows of equal order are numbered as the sort leaves them; they are written, so the numbers stay. Null recordings are one recording.
    """
    spark = df.sparkSession
    place, part = _free(df, "_place"), _free(df, "_part")
    flags = {name: _free(df, f"_is_{name}") for name in counts}
    marked = df.withColumns({flags[n]: F.coalesce(c, F.lit(False)).cast("long") for n, c in counts.items()})
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(b) for b in by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranged = marked.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    written = stored(ranged.withColumn(place, F.monotonically_increasing_id()), "ordered").withColumn(part, F.shiftright(place, 33))
    ranges = written.groupBy(*by, part).agg(*(F.sum(f).alias(f"sum{f}") for f in flags.values()))
    past = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*(F.col(b).alias(f"_key{i}") for i, b in enumerate(by)), F.col(part).alias("_key_part"), *(F.coalesce(F.sum(f"sum{f}").over(past), F.lit(0)).alias(f"before{f}") for f in flags.values()))
    same = F.col(part) == F.col("_key_part")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_key{i}"))
    within = Window.partitionBy(*by, part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    inner = written.withColumns({f"in{f}": F.coalesce(F.sum(f).over(within), F.lit(0)) for f in flags.values()})
    return inner.join(before, same).select(*df.columns, *((F.col(f"in{f}") + F.col(f"before{f}")).alias(n) for n, f in flags.items()))


def in_blocks(df: DataFrame, place: str, reach: int, block: int | None = None) -> tuple[DataFrame, str, Column]:
    """(rows, each in the block of its ``place`` and in those behind it that reach it; the block's column; whether a row is at home there).

    ``reach``: how many rows before it a row's window covers.
    """
    block = max(block or BLOCK, 8 * reach)
    name = _free(df, "_block")
    first = F.expr(f"{place} div {block}")
    return df.withColumn(name, F.explode(F.sequence(first, F.expr(f"({place} + {reach}) div {block}")))), name, F.col(name) == first


def last_rows(df: DataFrame, by: Sequence[str], place: str, rows: int, made: dict, block: int | None = None) -> DataFrame:
    """``df`` with columns ``made`` (functions of a window): of each row and the ``rows`` - 1 before it in its recording, by ``place``."""
    spread, name, home = in_blocks(df, place, rows - 1, block)
    window = Window.partitionBy(*by, name).orderBy(place).rowsBetween(1 - rows, 0)
    return spread.withColumns({c: f(window) for c, f in made.items()}).filter(home).drop(name)
