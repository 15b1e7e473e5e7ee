"""Distributed connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

DataFrame operations only. Each step groups by node and keeps one minimum per node, so that a node with millions of
neighbours is a partial aggregate and never a list. The minima of such nodes, few by their definition, are broadcast to
their edges; those of other nodes meet theirs in a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import cut_and_measure, forget, join_hot


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Distinct edges, written out, their number and an order-free digest."""
    return cut_and_measure(edges.distinct(), n=F.count(F.lit(1)), digest=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, dict]:
    """One step. large: each node links its larger neighbours to its least; small: its smaller ones and itself."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
    joined = join_hot(near, least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _written(out.where("a <> b"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge between two different nodes; component is its least node.

    Node ids may be of any ordered type. Null ends, loops and repeated edges are ignored; no edges give no rows.
    The edge set is written to the shared folder after each step, and a round that changes nothing ends the loop:
    the edges are then stars around the least nodes. Rounds grow with the logarithm of the node count; more than
    max_rounds raise RuntimeError rather than return unfinished components.
    """
    now, seen = _written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b"))
    state = None
    for _ in range(max_rounds):
        if seen["n"] == 0 or seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = seen
        half, _ = _star(now, large=True)
        forget(now)
        now, seen = _star(half, large=False)
        forget(half)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
