"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest neighbour of each node; written, so that the join with it reads both sides anew and Spark can split a node with very many edges."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour, or to the node itself if that is smaller."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.where("v > u").join(_least(both).hint("merge"), "u")
    return moved.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the smallest of these."""
    least = _least(edges)
    moved = edges.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node of an edge (a, b) that isn't its own root.

    Each round writes its edges to the shared folder, so lineage stays short and
    a lost executor costs one round. Ends when every edge points at a root.
    Loops and repeated or null edges do no harm.
    """
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("tail"), F.lit(0).alias("head")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("tail"), F.lit(1).alias("head")))
        if ends.groupBy("n").agg(F.sum("tail").alias("t"), F.max("head").alias("h")).where("t > 1 or (t = 1 and h = 1)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = materialize(_small_star(materialize(_large_star(now), "stars")), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
