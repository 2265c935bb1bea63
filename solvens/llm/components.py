"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.session import materialise

#: Edges of a task: a graph of fewer stays in one and needs no shuffle, whatever the number of shuffle partitions.
EDGES = 1 << 15


def _both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ways).alias("e")).select("e.u", "e.v")


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether each node that has a smaller neighbour has that one only."""
    # In both directions a node is u once an edge; v < u for those towards a smaller node.
    nodes = _both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    row = nodes.agg(F.sum("n"), F.max((F.col("v") < F.col("u")) & (F.col("n") > 1))).first()
    return (row[0] or 0) // 2, not row[1]


def components(edges: DataFrame) -> DataFrame:
    """u, v: every node of ``edges`` (u, v: long) that isn't the smallest of its component, with that smallest node.

    Edges are replaced by edges to smaller nodes until each component is a star; the number of rounds grows with
    the logarithm of the number of nodes.  Minima are taken before anything is joined, so a node
    of many neighbours adds one row per task.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialise(edges, "edges")
    n = edges.count()
    while True:
        tasks = max(1, -(-n // EDGES))
        edges = edges.coalesce(tasks)
        n, done = _stars(edges)
        if done:
            return edges
        both = _both_ways(edges)
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u <> v").distinct()
        large = materialise(large.coalesce(tasks), "edges").coalesce(tasks)
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        inner = large.join(least, F.col("u") == F.col("_u")).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        small = inner.unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).coalesce(tasks).distinct()
        edges = materialise(small.coalesce(tasks), "edges")
