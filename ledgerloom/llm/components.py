"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or its smaller) neighbours and itself to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select("a", F.col("m").alias("b"))
    moved = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) names; a component is its least node.

    Links may come in either direction, twice, or from a node to itself; links with a null
    are ignored.  Each round is checkpointed, and no component is ever on the driver.  A
    hub's least neighbour is aggregated before the shuffle; its links, two keys each, meet
    in one task, which streams them.
    """
    a, b = F.col("a"), F.col("b")
    state = durable(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    nodes = state.where("a = b").select("a", "b")
    state = state.where("a > b")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = durable(_star(_star(state, large=True), large=False).where("a > b"))
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = state.select(F.col("b").alias("a"), "b")
    return state.unionByName(roots).unionByName(nodes).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))
