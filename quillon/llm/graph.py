"""Connected components by alternating large and small stars.

Every round is two aggregations and two joins on node ids, with map-side
minima.  Only a node's minimum meets its links, so a node with very many links
would make one large join key: nodes with more than a thousandth of all links
(under two thousand of them, whatever the graph) get their minima by
broadcast, and the join by shuffle has the others only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import cut

#: A node is a hub from so large a part of all links on: at most 2 * HUB nodes are.
HUB = 1000


def _with_least(links: DataFrame, low: DataFrame, limit: int) -> DataFrame:
    """links (u, ...) with the columns m, n of their node in low (u, m, n)."""
    hubs = F.broadcast(low.where(F.col("n") > limit))
    rest = links.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") <= limit), "u")
    return links.join(hubs, "u").unionByName(rest)


def _large(e: DataFrame, limit: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    return _with_least(both.where("v > u"), low, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(e: DataFrame, limit: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(e, low, limit).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _look(state: DataFrame) -> tuple[int, int]:
    """How many links there are, and how many nodes that keep them from being stars: children with two parents or of a child."""
    ends = state.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    got = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()
    return int(got[0]), int(got[1])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every node of edges (u, v) with a smaller neighbour in its component.

    root is the smallest id of the component; the roots themselves and nodes
    without links are not listed.  Loops and repeated edges are ignored.
    Edges that are stars already, each around its smallest node, are the
    answer: a look at them ends the rounds.
    """
    pair = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    state = cut(pair)
    for _ in range(rounds):
        links, astray = _look(state)
        if not astray:
            return state.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = cut(_small(_large(state, links // HUB), max(1, links // HUB)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
