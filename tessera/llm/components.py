"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed throughout: a round is two aggregations and two joins on
the edge table, whose result is checkpointed.  No node's neighbourhood is ever
gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds double the span that a label has crossed, so this bound is beyond any real table.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(u, v)``; root is the component's smallest node.

    Loops and null ends are ignored, repeated edges count once, and a table
    without edges gives an empty result.
    """
    now = cut(edges.select("u", "v").filter("u <> v").distinct())
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        now = cut(_small_star(_large_star(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components are not stable after {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
