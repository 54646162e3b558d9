"""Graph operators over edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def closure(edges: DataFrame, seeds: DataFrame, hops: int, reverse: bool = True, once: bool = True) -> DataFrame:
    """(id, depth): nodes within `hops` steps of any of `seeds` (id), seeds left out, with the least number of steps.

    reverse follows edges from dst to src (who calls), else from src to dst. One frontier for all seeds: each hop is a join of the
    frontier with the edges, cleared of nodes seen before; the frontier is written to the shared folder, so that plans stay short. Cycles and
    self-loops end with the visited set; a node that many paths reach comes once. Empty seeds give no rows. The edges are worked out
    once and read by every hop; without `once` they are taken as they come, for edges that are stored already.
    """
    here, there = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(here).alias("id"), F.col(there).alias("next"))
    if once and hops > 1:
        steps = cut(steps)
    seen = cut(seeds.select("id").dropna().distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, hops + 1):
        reached = frontier.select("id").join(steps, "id").select(F.col("next").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): distinct callers and callees of each node that has any."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
