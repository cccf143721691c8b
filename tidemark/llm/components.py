"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two grouped
minima and two equi-joins, so hubs pre-aggregate before the shuffle; a small graph's joins are by
broadcast. Rounds are settled in the shared folder, each deleted when the next is there;
nothing reaches the driver but two sums that tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, settle


def _star(edges: DataFrame, minima: DataFrame, n: int) -> DataFrame:
    """``edges(u, v)`` with the ``m`` of their ``u``, of which there are ``2 * n`` at most: by broadcast if those are
    few, else by a shuffle whose large partitions, a hub's among them, adaptive execution splits."""
    return edges.join(F.broadcast(minima) if 2 * n <= BROADCAST_ROWS else minima, "u")


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _star(both, low, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _star(down, low, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``: each node that has an edge to another node, with
    the smallest node it reaches; rounds go on until no edge changes. Loops, repeated edges and nulls are ignored; an empty table
    gives an empty result. A node that is itself the smallest has no row."""
    now = settle(edges.where("u is not null and v is not null and u <> v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, before = (seen["n"], seen["h"]), now
        now = settle(_small(_large(now, seen["n"]), seen["n"]), "edges")
        forget(before)
