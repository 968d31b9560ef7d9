"""Donor-aware localisation of scores in cell types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pseudobulk(cells: DataFrame, value: str, keys: list[str], least_cells: int) -> DataFrame:
    """n, mean and median of a score per key (NULL keys keep their group), for groups of enough cells."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.avg(value).alias("mean"), F.median(value).alias("median")).filter(F.col("n_cells") >= least_cells)


def cell_type_summary(bulk: DataFrame, donor: str, cell_type: str, least_donors: int) -> DataFrame:
    """Across donors: their number, cells, median, mean, quartiles, minimum and maximum of the means."""
    return bulk.groupBy(cell_type).agg(F.count_distinct(donor).alias("n_donors"), F.sum("n_cells").alias("n_cells"), F.median("mean").alias("median"), F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.25)).alias("q25"), F.percentile("mean", F.lit(0.75)).alias("q75"), F.min("mean").alias("minimum"), F.max("mean").alias("maximum")).filter(F.col("n_donors") >= least_donors)


def rank_stability(bulk: DataFrame, donor: str, cell_type: str) -> DataFrame:
    """Rank of each cell type by mean over donors, in full and without each donor in turn."""
    donors = bulk.select(F.col(donor).alias("_left")).distinct()
    kept = bulk.join(donors, F.col(donor) != F.col("_left"))  # donors are a handful
    without = kept.groupBy("_left", cell_type).agg(F.avg("mean").alias("m")).withColumn("_r", F.row_number().over(W.partitionBy("_left").orderBy(F.desc("m"), cell_type)))
    full = bulk.groupBy(cell_type).agg(F.avg("mean").alias("m")).withColumn("full_rank", F.row_number().over(W.orderBy(F.desc("m"), cell_type))).drop("m")
    return without.join(full, cell_type).groupBy(cell_type).agg(F.max("full_rank").alias("full_rank"), F.min("_r").alias("best_rank"), F.max("_r").alias("worst_rank"), F.median("_r").alias("median_rank"), F.max(F.abs(F.col("_r") - F.col("full_rank"))).alias("largest_change"))


def paired_differences(bulk: DataFrame, donor: str, cell_type: str, a: str, b: str) -> DataFrame:
    """Donors' mean in type a minus type b, where both are there."""
    return bulk.groupBy(donor).agg(F.max(F.when(F.col(cell_type) == a, F.col("mean"))).alias("_a"), F.max(F.when(F.col(cell_type) == b, F.col("mean"))).alias("_b")).withColumn("difference", F.col("_a") - F.col("_b")).filter("difference is not null").select(donor, "difference")


def bootstrap_interval(values: DataFrame, value: str, schedule: DataFrame) -> DataFrame:
    """Percentile interval of the mean under an index schedule (rep, pos, idx), values placed by `pos`."""
    drawn = schedule.join(values.select(F.col("pos").alias("idx"), value), "idx").groupBy("rep").agg(F.avg(value).alias("m"))
    return drawn.agg(F.count("m").alias("repeats"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def gene_localisation(cells: DataFrame, gene: str, cell_type: str, value: str, least_cells: int = 100) -> DataFrame:
    """Type with the highest mean of each gene, its mean and the range over types of enough cells."""
    means = cells.groupBy(gene, cell_type).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m")).filter(F.col("n") >= least_cells)
    return means.groupBy(gene).agg(F.max_by(cell_type, F.struct("m", cell_type)).alias("top_type"), F.max("m").alias("top_mean"), (F.max("m") - F.min("m")).alias("specificity_range"), F.count(F.lit(1)).alias("n_types"))


def detection_fraction(cells: DataFrame, gene: str, value: str) -> DataFrame:
    """Share of a gene's rows above zero."""
    return cells.groupBy(gene).agg(F.avg((F.col(value) > 0).cast("double")).alias("detected"))
