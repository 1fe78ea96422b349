"""Connected components of a graph given by edges, by alternating large-star and small-star steps.

Every step keeps all connections and at most as many edges; each round is written to the shared
folder. A hot node's edges are joined with the node's minimum, a table of one row a node that was
written before, so that AQE can split them; minima are summed up before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours go to its least neighbour (itself included). Small star: its smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("least")), "least")
    joined = both.join(least, both["u"] == least["node"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v long. Returns node, component (the smallest node reachable), for every node of an edge."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = stored(_star(stored(_star(now, True), "large"), False), "small")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("nodes"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state == (row.n, row["sum"]):
            break
        state = (row.n, row["sum"])
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
