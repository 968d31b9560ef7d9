"""Connected components of a graph given as pairs, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _lowest(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours: (u, m). Combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(pairs: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of the pairs; the component is its smallest node.

    Large-star: each node's larger neighbours are tied to its smallest one. Small-star: its smaller
    neighbours are. After O(log n) rounds all are stars around their smallest node. A node with many
    neighbours is one partially aggregated key; the joins on it can be split by adaptive execution.
    """
    edges = pairs.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).filter("u > v").distinct()
    edges = materialise(edges, "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large).withColumnRenamed("u", "w")
        joined = large.join(low, large.u == low.w).select("u", "v", "m")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
