"""Helpers shared by the corpus operators: tables, Arrow batch limits and the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.session import checkpoint_dir, remove_path, ship_package

#: The six ASCII white-space characters of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name``, read by Spark so that any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (long texts must not add up to gigabytes in a worker), and ship the package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception:  # older releases lack the byte bound; the row bound still holds
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a local session (one machine) gets a temporary folder of its own; on a cluster that is an error,
    since executors would write to disks that others can't read.
    """
    return checkpoint_dir(spark)


#: Paths that were made and not yet removed, in order.
_made: list[str] = []
#: What the query that runs in this context has made; other threads have records of their own.
_record: ContextVar[list[str] | None] = ContextVar("kymo_made", default=None)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends or where it was made under ``temporary``, with that."""
    path = f"{shared_dir(spark)}/kymo/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    _made.append(path)
    if (record := _record.get()) is not None:
        record.append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        remove_path(spark, path)
        if path in _made:
            _made.remove(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Files that operators write within are removed at its end: read, write or count their results before that.

    It holds for the thread that enters it. What is taken out of the list that it gives, stays.
    """
    mine: list[str] = []
    token = _record.set(mine)
    try:
        yield mine
    finally:
        _record.reset(token)
        _remove(spark, mine)


def finished(build: Callable[[], DataFrame], tag: str, before: DataFrame | None = None) -> DataFrame:
    """What ``build`` gives, written; the files that it made on the way are removed, and those of ``before``, an earlier result.

    Files of other queries, also of those that run meanwhile in other threads, stay.
    """
    made = build_spark = None
    mine: list[str] = []
    token = _record.set(mine)
    try:
        made = build()
        build_spark = made.sparkSession
        out = written(made, tag)
        kept = mine.pop()
    finally:
        _record.reset(token)
        if build_spark is not None:
            _remove(build_spark, mine)
    if before is not None:
        _remove(build_spark, [before._kymo_path])
    if (outer := _record.get()) is not None:
        outer.append(kept)
    out._kymo_path = kept
    return out


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores more as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def whole_key(df: DataFrame, key: str) -> Column:
    """Column ``key`` as a long; a key of another type than a whole number is an error, as results order keys."""
    if (kind := dict(df.dtypes)[key]) not in WHOLE_NUMBERS:
        raise TypeError(f"{key} must hold whole numbers, not {kind}")
    return df[key].cast("long")


def numbered(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written with a number for each row, and that column's name, which differs from all others.

    The numbers are drawn in the one job that writes them and read back as data ever after. A number that is computed
    again by a later job may meet another row: how a scan is cut follows the cores that are registered at that time.
    """
    row = free_name(df, "_row_")
    return written(df.withColumn(row, F.monotonically_increasing_id()), tag), row


def few(spark: SparkSession) -> int:
    """Partitions for an aggregate, which is much smaller than what it was made from: an eighth of those of a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def apart(df: DataFrame) -> DataFrame:
    """An aggregate dealt evenly over tasks, for a join on its keys.

    As it is, an aggregate lies by its keys and the join would only exchange the other side, which Spark then can't split
    where a key is very frequent. Behind this small exchange both sides get one, and it may.
    """
    return df.repartition(few(df.sparkSession))


def lowest(df: DataFrame, order: Column, n: int, rows: int | None = None) -> DataFrame:
    """The ``n`` rows of ``df`` with the least ``order``, a 64-bit hash.

    A cut comes first, so that the ranking sees few rows whatever the size of the table. Without ``rows`` it comes from counts of the hashes' first
    16 bits and holds n rows for certain, equal hashes or not. Where hashes are those of distinct keys, ``rows`` (how many rows
    there are) spares these counts: hashes are spread evenly, so the share that holds about 2n + 50 rows will do.
    (Fewer than n below that cut has a probability under 1e-9 and would give fewer rows.)
    """
    ranked = df.withColumn("_order", order)
    if rows is None:
        counts = ranked.groupBy(F.shiftright("_order", 48).alias("first")).count().orderBy("first").collect()  # at most 65,536
        found = 0
        for r in counts:
            found += r["count"]
            if found >= n:
                ranked = ranked.filter(F.shiftright("_order", 48) <= r["first"])
                break
    else:
        share = min(1.0, (2 * n + 50) / max(1, rows))
        if share < 1:
            ranked = ranked.filter(F.col("_order") < int(-(2**63) + share * 2**64))
    return ranked.orderBy("_order").limit(n).drop("_order")


def map_rows(df: DataFrame, per_batch: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Run ``per_batch`` (columns as lists in, columns as lists out) on every Arrow batch of ``df``.

    ``per_batch`` may return another number of rows than it got.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = per_batch({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
