"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import shared


def components(edges: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(node, root): the smallest value (nulls aside) of the nodes that each node of `edges`
    (a, b) is connected to. `values` (node, low) has one row a node; by default a node's value is
    the node itself.

    Randomised contraction: every round each node picks, of itself and its neighbours, the one
    with the smallest hash under the round's function, and what picked the same node becomes one
    node. A round leaves a constant share of the nodes, whatever the shape of the graph and the
    order of ids, so chains of n take about log n rounds. Rounds go on until no edge is left; the
    picks are then followed back. Nothing but whether edges are left reaches the driver. A key is
    as hot as a node has edges, so callers keep degrees low (see `tree`).
    """
    def ordered(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    live, left = shared.table(edges.where("a <> b").select(*ordered("a", "b")).distinct())
    if not left:
        return live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    picks = []
    while left:
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        by_hash = lambda c, salt=len(picks): F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("pick"))
        near = ends.groupBy("node").agg(F.min(by_hash("other")).alias("near"))
        pick = near.select("node", F.least(F.col("near"), by_hash("node"))["pick"].alias("via"))
        # The pick of the pick, so that a round does the work of two.
        pick, _ = shared.table(pick.join(pick.select(F.col("node").alias("via"), F.col("via").alias("pick")), "via").select("node", "pick"))
        picks.append(pick)
        to = lambda c, pick=pick: pick.select(F.col("node").alias(c), F.col("pick").alias(f"{c}2"))
        moved = live.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        live, left = shared.table(moved.select(*ordered("a2", "b2")).distinct())
    found = picks.pop()
    while picks:  # nodes without edges in a later round stay what they were
        later = found.select(F.col("node").alias("pick"), F.col("pick").alias("last"))
        found = picks.pop().join(later, "pick", "left").select("node", F.coalesce("last", "pick").alias("pick"))
    found, total = shared.table(found)
    valued = found.withColumn("low", F.col("node")) if values is None else found.join(values, "node")
    roots = valued.groupBy("pick").agg(F.min("low").alias("root"), F.count("*").alias("size"))
    return shared.meet(found, roots, ["pick"], "size", total, F.col("node")).select("node", "root")


def tree(nodes):
    """Parents of all but the first of `nodes` that make them one tree of degree nine at most."""
    return [nodes[(i - 1) >> 3] for i in range(1, len(nodes))]
