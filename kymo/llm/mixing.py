"""Mixing sources to target weights with capped water-filling, in DataFrame operations only.

Targets. Sources share ``share`` times all sizes by weight; a source takes at most ``max_epochs`` times its own size.
Clamp what would be above, share the excess by weight among the rest, and again until none is above. The level at which
this settles is found in closed form: with sources by size over weight, the clamped ones are a prefix, and running
sums give the level after each prefix. Sources and their sums are one row each, aggregated before any shuffle.

Sampling. A target of e epochs takes every document floor(e) times, and a seeded sample for the fraction: documents
in the order of a seeded digest, whole, until the words that are left run out; the document at which they do gives
just those words (``cut_last``) or is taken whole if that is nearer. Running sums go over 4096 ranges of the digest
for each source: ranges are summed first, so that a source with a third of all rows is spread over as many tasks.

Results: a null text counts 0 words and takes 0; a null source is a source of its own, after all others, and empty
is one too; equal keys order by size, then by text digest, and rows equal in all of these are interchangeable. An empty
table gives no rows. The same rows and seed give the same result in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import written

WEIGHTS = (3, 1, 2)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_null, _name, source_size, target) from (_null, _name, source_size); weights repeat over sources by code point, null last.

    The windows without partition see one row for each source.
    """
    pattern = ", ".join(map(str, weights))
    return sums.sparkSession.sql(f"""
      with ranked as (
        select *, row_number() over (order by _null, _name) - 1 as src from {{sums}}),
      weighted as (
        select *, element_at(array({pattern}), cast(src % {len(weights)} as int) + 1) as weight, {max_epochs} * source_size as cap from ranked),
      running as (
        select *, sum(cap) over (order by cap / weight, src rows between unbounded preceding and current row) - cap as caps_before,
          sum(weight) over (order by cap / weight, src rows between current row and unbounded following) as weight_left,
          {share}D * sum(source_size) over () as total from weighted),
      levels as (
        select *, max(case when (total - caps_before) * weight <= cap * cast(weight_left as double) then (total - caps_before) / weight_left end) over () as level from running)
      select _null, _name, source_size, least(cast(cap as double), coalesce(level, double('infinity')) * weight) as target
      from levels""", sums=sums)


def _mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, cut_last: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(_key, size, source_size, target, taken, whole, part) and the columns ``keep`` under _keep_ and their place."""
    digest = F.md5(F.concat_ws(":", df[key].cast("string"), F.lit(seed), F.md5(df[text].cast("binary"))).cast("binary"))
    sized = df.select(
        df[key].alias("_key"), df[source].isNull().alias("_null"), F.coalesce(df[source], F.lit("")).alias("_name"),
        word_count(df[text]).alias("size"), digest.alias("_draw"), *[df[c].alias(f"_keep_{i}") for i, c in enumerate(keep)],
    ).withColumn("_range", F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int"))
    sized = written(sized, "mix-sizes")  # words are counted and digests taken once
    of = ["_null", "_name"]
    ranges = sized.groupBy(*of, "_range").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy(*of).agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    before = F.expr("sum(range_size) over (partition by _null, _name order by _range) - range_size")
    plan = ranges.withColumn("range_before", before).join(goal, of).select(*of, "_range", "source_size", "target", "whole", "extra", "range_before")
    running = F.expr("""sum(size) over (partition by _null, _name, _range order by _draw, _key nulls last, size
      rows between unbounded preceding and current row) - size + range_before""")
    left = F.col("extra") - F.col("_before")
    part = F.greatest(F.lit(0), F.least("size", left)) if cut_last else F.when((left > 0) & (2 * left >= F.col("size")), F.col("size")).otherwise(0)
    mixed = sized.join(plan, [*of, "_range"]).withColumn("_before", running).withColumn("_part", part.cast("long"))
    return mixed.select(
        "_key", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("_part")).alias("taken"), "whole", F.col("_part").alias("part"),
        *[f"_keep_{i}" for i in range(len(keep))])


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """(key, size, source_size, target, taken, whole, part) of every row.

    ``taken`` is how many words the mix takes of a row: ``whole`` repetitions of it and ``part`` words more.
    """
    return _mix(df, key, text, source, **options).withColumnRenamed("_key", key)


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``df``, all columns, repeated as often as the mix takes them whole (never cut)."""
    taken = _mix(df, key, text, source, cut_last=False, keep=tuple(df.columns), **options)
    times = F.col("whole") + F.when((F.col("part") > 0) & (F.col("size") > 0), 1).otherwise(0)
    repeated = taken.withColumn("_times", times).filter(F.col("_times") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return repeated.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(df.columns)])
