"""Connected components of an edge table by alternating large and small stars, without any graph on the driver.

A hub's edges share a key. The smallest neighbour of each node, which the edges meet in a join, is one row a node: it
travels while the graph is counted to be small, and is a written table of its own beyond, so that adaptive execution
can split a hub's edges over tasks. Minima are folded before they travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import BROADCAST_ROWS, discard, written


def _with_least(edges: DataFrame, few: bool, least: Column, used: list[DataFrame]) -> DataFrame:
    """edges with m, the smallest v of each u, as `least` has it."""
    own = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", least.alias("m"))
    if few:
        return edges.join(F.broadcast(own), "u")
    used.append(written(own, "edges-least"))
    return edges.join(used[-1], "u")


def _star_round(edges: DataFrame, few: bool) -> DataFrame:
    used: list[DataFrame] = []
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both, few, F.least("m", "u"), used).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not few:
        used.append(large := written(large.distinct(), "edges-large"))
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _with_least(down, few, F.col("m"), used)
    out = written(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
    discard(*used)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node it is connected with.

    Stars shrink distances by half each round, so rounds grow with the logarithm of the longest path. An empty edge
    table gives an empty result; loops and repeated edges change nothing.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    now, before = written(edges.where("u <> v").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        last, now = now, _star_round(now, mark[0] <= BROADCAST_ROWS)
        discard(last)
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("root")), nodes["node"] == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"))
