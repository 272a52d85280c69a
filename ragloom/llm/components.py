"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the least node.

    Raises an error where that many rounds don't suffice, which only a path of more than 2**rounds nodes could need.
    Alternates large-star and small-star steps, which needs a number of rounds
    that grows with the logarithm of the longest path, each two shuffles of the
    edges. Lineage is cut by a checkpoint each round. Loops and repeated edges do
    no harm; no edges give no rows.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Links neighbours (the larger ones, or the others and the node itself) to the least of node and neighbours."""
        if large:
            near = both(e)
            least = near.groupBy("a").agg(F.min("b").alias("m"))
            joined = near.join(least, "a").where(F.col("b") > F.col("a"))
            return joined.select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        joined = near.join(least, "a")
        linked = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        return linked.select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    before = state(now)
    for _ in range(rounds):
        now = checkpointed(star(star(now, True).distinct(), False).where("a <> b").distinct())
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops).distinct()
