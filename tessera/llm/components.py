"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours link to its smallest neighbour, or to itself. (The cut lets the join
    divide the links of a hub.)"""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Edges point downwards: each node's smaller neighbours and the node itself link to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    onward = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v): one row (node, root) for each node of an edge; root is the component's smallest node.

    Every round keeps the components and at least halves the depth of long chains; rounds are cut to the
    shared folder, and only three sums of a round reach the driver."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        edges = cut(_small(_large(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
