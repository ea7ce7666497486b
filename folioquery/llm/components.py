"""Connected components by contraction: every step is a shuffle of pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def flattened(parent: DataFrame) -> DataFrame:
    """(v, p) with p replaced by its own parent until nothing changes: pointer jumping."""
    while True:
        up = parent.toDF("v2", "p2")
        jumped = parent.join(up, F.col("p") == F.col("v2")).select("v", F.col("p2").alias("p"), (F.col("p") != F.col("p2")).alias("moved"))
        jumped = common.cut(jumped, "cc-jump")
        parent = jumped.select("v", "p")
        if not jumped.where("moved").take(1):
            return parent


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    In each round a node takes its smallest neighbour (or itself) as parent, parents are flattened, and edges
    are drawn anew between the roots, which at least halves the nodes that still have edges.
    """
    edges = common.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    known: DataFrame | None = None
    while edges.take(1):
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        parent = common.cut(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")), "cc-parent")
        parent = flattened(parent)
        a, b = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        drawn = edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
        edges = common.cut(drawn.distinct(), "cc-edges")
        if known is None:
            known = parent.toDF("node", "root")
        else:
            moved = known.join(parent, F.col("root") == F.col("v"), "left").select("node", F.coalesce("p", "root").alias("root"))
            known = common.cut(moved, "cc-known")
    if known is None:
        return edges.toDF("node", "root")
    return known
