"""Connected components of an edge list by alternating star contractions.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) as joins and aggregates over written tables.  Each
step joins all edges with the nodes that still change (a parent that has a
smaller neighbour, or a node with several parents) and writes the edges anew, so
finished stars are moved along until all are finished.  A hub's rows are
combined before they are shuffled, and Spark's skew join may split a hub's side
of a join, as both sides are plain scans.  The rounds grow with the logarithm of
the longest path; no node's neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortvox.sources.workspace import Workspace


def _nodes(edges: DataFrame) -> DataFrame:
    """Per node its smallest neighbour or itself, how many smaller neighbours it has, and whether it is one."""
    up = edges.select(F.col("u").alias("node"), F.col("v").alias("m"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("v").alias("node"), F.col("v").alias("m"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    return up.unionByName(down).groupBy("node").agg(F.min("m").alias("m"), F.sum("up").alias("up"), F.max("down").alias("down"))


def components(edges: DataFrame, a: str, b: str, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge to another node.

    ``component`` is the smallest node reachable.  Nodes are BIGINT; edges that
    are null or loops are ignored, repeated and reversed edges are allowed.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    e = ws.table(e, "edges")
    for _ in range(max_rounds):
        nodes = ws.table(_nodes(e).where("(down = 1 and up > 0) or up > 1"), "nodes")
        chained, several = nodes.agg(F.count_if(F.expr("down = 1 and up > 0")), F.count_if(F.expr("up > 1"))).first()
        if not chained and not several:
            break
        if chained:  # large star: the larger neighbours of a node go to its smallest one
            low = nodes.where("down = 1 and up > 0").select(F.col("node").alias("v"), "m")
            new = ws.table(e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
            ws.drop(e, nodes)
            e = new
            nodes = ws.table(_nodes(e).where("up > 1"), "nodes")
            several = nodes.count()
        if several:  # small star: a node and its smaller neighbours go to the smallest of them
            low = nodes.where("up > 1").select(F.col("node").alias("u"), "m")
            joined = e.join(low, "u", "left")
            moved = F.when(F.col("m").isNull() | (F.col("v") == F.col("m")), F.col("u")).otherwise(F.col("v"))
            new = ws.table(joined.select(moved.alias("u"), F.coalesce("m", "v").alias("v")).distinct(), "stars")
            ws.drop(e, nodes)
            e = new
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
