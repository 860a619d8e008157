"""Connected components of an edge table, without bringing links or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget_finished, written


def _least(edges: DataFrame) -> DataFrame:
    """Per node the least of its neighbours and itself; aggregated on the map side, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether each edge leads from a node with no other edge to one that leads nowhere; aggregated on the map side."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leads")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leads")))
    nodes = ends.groupBy("node").agg(F.sum("leads").alias("n"), F.min("leads").alias("least"))
    return not nodes.agg(F.max((F.col("n") > 1) | (F.col("n") == 1) & (F.col("least") == 0))).first()[0]


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge to another; edges are (a, b).

    Alternates the large-star and small-star steps, which need about log(nodes) rounds and keep no more edges than
    at first, until all edges form stars. The edges of each round are written to the shared folder, which cuts the
    lineage, and the driver lets go of what the round before has left. The joins are by node; adaptive execution
    splits a hub's rows. Self-loops, nulls and repeated edges are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    for _ in range(rounds):
        forget_finished(e.sparkSession)
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    # A star's centre is its least node, for u > v in all edges.
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
