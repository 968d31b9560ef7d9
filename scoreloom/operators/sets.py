"""Gene set overlap and rediscovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame, a_set: str, b_set: str, item: str) -> DataFrame:
    """Sizes, overlap, Jaccard, F1, recall and precision of the set pairs that share an item.

    An equi-join on the item: pairs without a common item never arise.
    """
    a, b = a.select(a_set, item).distinct(), b.select(b_set, item).distinct()
    na, nb = a.groupBy(a_set).agg(F.count(F.lit(1)).alias("n_a")), b.groupBy(b_set).agg(F.count(F.lit(1)).alias("n_b"))
    both = a.join(b, item).groupBy(a_set, b_set).agg(F.count(F.lit(1)).alias("n_overlap")).join(na, a_set).join(nb, b_set)
    o = F.col("n_overlap")
    return both.withColumns({"jaccard": o / (F.col("n_a") + F.col("n_b") - o), "f1": 2 * o / (F.col("n_a") + F.col("n_b")), "recall": o / F.col("n_a"), "precision": o / F.col("n_b")})


def best_match(overlaps: DataFrame, a_set: str, b_set: str) -> DataFrame:
    """The partner of each set with the highest F1, then overlap, then name."""
    order = W.partitionBy(a_set).orderBy(F.desc("f1"), F.desc("n_overlap"), b_set)
    return overlaps.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def rediscovery_class(n: Column, q: Column, recall: Column, stability: Column) -> Column:
    """Ordered classes of a blind rediscovery."""
    return F.when(n < 3, "insufficient_overlap").when((q < 0.05) & (recall >= 0.30) & (stability >= 0.50), "strong_rediscovery").when((q < 0.10) & (recall >= 0.20), "partial_rediscovery").otherwise("not_rediscovered")


def preservation_class(edge_q: Column, loading_q: Column, random_p: Column, median: Column) -> Column:
    """How many of edges, loadings, panel specificity and reliability support preservation."""
    support = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (edge_q < 0.05, loading_q < 0.05, random_p < 0.05, median >= 0.60)), F.lit(0))
    return F.when(support == 4, "preserved").when(support >= 2, "partially_preserved").when(support == 1, "weak_evidence").otherwise("not_preserved")
