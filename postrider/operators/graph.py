"""Connected components by joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import joins_by_shuffle, stage


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.

    Each round every node points to the smallest neighbour below it, pointers
    are shortened to the grandparent, and other edges move to the ends of these
    pointers; it is over when all edges lead from a node to its root. Depth
    halves each round. What a round makes is written to the shared folder, so a
    lost executor costs no more than the round. Self loops, repeated edges and
    edges with a null end are left out.
    """
    hi, lo = F.greatest(src, dst), F.least(src, dst)
    e = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(hi.alias("hi"), lo.alias("lo")).filter("hi > lo")
    e = stage(e.distinct())
    with joins_by_shuffle(edges.sparkSession):
        return _shortened(e)


def _shortened(e: DataFrame) -> DataFrame:
    while True:
        # Not staged: both sides of the join below read one shuffle of the edges, and one side needs no other.
        up = e.groupBy("hi").agg(F.min("lo").alias("up"), F.count("*").alias("n"))
        above = up.select(F.col("hi").alias("up"), F.col("up").alias("top"))
        top = stage(up.join(above, "up", "left").select("hi", "up", F.coalesce("top", "up").alias("top"), (F.col("top").isNotNull() | (F.col("n") > 1)).alias("open")))
        if not top.filter("open").head(1):
            return top.select(F.col("hi").alias("node"), F.col("up").alias("component")).union(top.select("up", "up").distinct())
        rest = e.join(top, "hi").filter("lo <> up")
        moved = rest.select(F.greatest("lo", "top").alias("hi"), F.least("lo", "top").alias("lo")).filter("hi > lo")
        e = stage(top.select("hi", F.col("top").alias("lo")).union(moved).distinct())
