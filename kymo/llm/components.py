"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Every round is an aggregate and an equi-join, both keyed by a node: no component, neighbour list or edge list is ever
brought to the driver or into one task, and a node with very many neighbours is one row of an aggregate, and rows of a join
side that Spark may split. Each round is written to the shared folder, so lineage stays short and lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import apart, few, written


#: Edges that one file of a round holds.
FILE_EDGES = 500_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a and b, any order, self-loops and repeats allowed).

    ``root`` is the smallest node that can be reached. Nodes must be of one sortable type; null ends are dropped. A
    round's files follow the number of edges, not of shuffle partitions: rounds are many and edges may be few.
    """
    star = written(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct().coalesce(few(edges.sparkSession)), "components")
    n = star.count()
    for _ in range(max_rounds):
        # large star: every node sends its larger neighbours to the smallest node around it, itself included
        both = star.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(star.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(apart(least), "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small star: every node sends its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(apart(least), "v")
        small = moved.select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").unionAll(least.select("v", F.col("m").alias("u"))).distinct()
        after = written(small.coalesce(1 + n // FILE_EDGES), "components")
        before, n = n, after.count()
        if n == before and after.join(star, ["v", "u"], "left_anti").isEmpty():
            break
        star = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return after.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(after.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
