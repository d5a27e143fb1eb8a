"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import SHUFFLED, cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.hint(SHUFFLED), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least.hint(SHUFFLED), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v: long, u <> v) to (node, root): root is the smallest node reachable.

    Only nodes with an edge appear. Minima are combined before the shuffle and a
    hub's edges go through joins whose skewed partitions Spark splits, so that no
    group is ever gathered in one task. Each round is cut in the shared folder;
    rounds go on until one changes nothing, about as often as the logarithm of a component's length.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen, now = None, state(edges)
    while now[0] and now != seen:
        edges, seen = cut(_small_star(_large_star(edges)), "stars"), now
        now = state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
