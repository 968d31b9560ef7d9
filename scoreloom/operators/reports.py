"""Whole result tables of a run over two cohorts: preservation with coverage, permutation inference, reliability.

Tables have one row per listed module, in the list's order, whether or not it could be estimated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.symbols import cleaned, keep_first
from scoreloom.operators import inference, preservation, resampling
from scoreloom.schemas import require_columns

REFERENCE, EXTERNAL = "reference", "external"


def preserved_program(weights: DataFrame, order: list[str]) -> DataFrame:
    """Frozen weights of the listed modules: cleaned symbols, the first row of each, 0 for a loading that is no number.

    A module without any row raises; one whose symbols are all empty has no genes.
    """
    require_columns(weights, "module_label", "gene", "loading", "ord")
    rows = weights.withColumn("module_label", F.col("module_label").cast("string")).filter(F.col("module_label").isin(order))
    absent = sorted(set(order) - {r[0] for r in rows.select("module_label").distinct().collect()})
    if absent:
        raise ValueError(f"no weights for module {', '.join(absent)}")
    named = rows.withColumns({"gene": cleaned(F.col("gene")), "loading": F.nanvl(F.coalesce("loading", F.lit(0.0)), F.lit(0.0))}).filter("gene != ''")
    return keep_first(named, ["module_label", "gene"], "ord")


def listed(df: DataFrame, order: list[str], base: int = 42, stride: int = 100) -> DataFrame:
    """The modules of a run (a short list) with their places and the seeds of their random streams."""
    places = df.sparkSession.createDataFrame(list(enumerate(order)), "position int, module_label string")
    return F.broadcast(inference.seeded(places, base, stride))


def estimable(genes: DataFrame, minimum_genes: int) -> DataFrame:
    """Rows of modules with enough genes; the others never reach a matrix."""
    enough = genes.groupBy("module_label").agg(F.count_distinct("gene").alias("_n")).filter(F.col("_n") >= minimum_genes)
    return genes.join(enough.select("module_label"), "module_label", "left_semi")


def preserved(z: DataFrame, weights: DataFrame, order: list[str], minimum_genes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(structure, coverage). `z` holds the cohorts 'reference' and 'external'; `weights` come from `preserved_program`."""
    modules = listed(z, order).select("position", "module_label")
    covered = preservation.coverage(z, weights, EXTERNAL, minimum_genes)
    coverage = modules.join(covered, "module_label", "left").fillna(0, ["n_frozen_genes", "n_common_genes"]).fillna("", ["common_genes", "missing_external_genes"])
    genes = estimable(preservation.module_genes(z, weights), minimum_genes)
    component = preservation.leading_component(genes, EXTERNAL)
    axis = component.groupBy("module_label").agg(F.max("variance_explained").alias("external_pc1_variance_explained"), F.max("orientation_correlation").alias("pc1_orientation_correlation_with_frozen_score"))
    edges = preservation.edge_preservation(preservation.edges_by_matrix(genes), REFERENCE, EXTERNAL).withColumnRenamed("spearman", "edge_spearman")
    loads = preservation.loading_preservation(component).withColumnRenamed("spearman", "loading_spearman")
    rows = coverage
    for part in (edges, loads, axis):
        rows = rows.join(part, "module_label", "left")
    ok = F.col("n_common_genes") >= minimum_genes
    structure = rows.orderBy("position").select(
        "module_label", "n_common_genes", "edge_spearman", "loading_spearman", "external_pc1_variance_explained", "pc1_orientation_correlation_with_frozen_score",
        ok.alias("estimable"), F.when(ok, "").otherwise(f"fewer_than_{minimum_genes}_common_genes").alias("nonestimable_reason"))
    return structure, coverage.orderBy("position").select("module_label", "n_frozen_genes", "n_common_genes", "coverage_fraction", "common_genes", "missing_external_genes")


def inferred(z: DataFrame, weights: DataFrame, order: list[str], minimum_genes: int = 3, repeats: int = 5000, base: int = 42, stride: int = 100) -> DataFrame:
    """Both permutation tests of every listed module with q values of the joint family."""
    if repeats < 1:
        raise ValueError("the number of permutations must be at least 1")
    genes = preservation.module_genes(z, weights)
    some = estimable(genes, minimum_genes)
    places = listed(z, order, base, stride)
    table = inference.inference_table(preservation.edges_by_matrix(some), preservation.leading_component(some, EXTERNAL), genes.filter(F.col("cohort") == EXTERNAL), weights, REFERENCE, EXTERNAL, repeats, minimum_genes, positions=places)
    return table.join(places.select("module_label", "position"), "module_label").orderBy("position").drop("position")


def reliability(z: DataFrame, weights: DataFrame, order: list[str], minimum_genes: int = 3, repeats: int = 2000, base: int = 42, stride: int = 100, offset: int = 2) -> tuple[DataFrame, DataFrame]:
    """(reliability, leave-one-out) of the external cohort: split halves by each module's own stream, and scores without each gene."""
    if repeats < 1:
        raise ValueError("the number of split-half repeats must be at least 1")
    places = listed(z, order, base, stride).withColumn("split_half_seed", F.lit(base) + F.col("position").cast("bigint") * stride + offset)
    every = z.filter(F.col("cohort") == EXTERNAL).select("cohort", "sample_id", "gene", "z").join(F.broadcast(weights.select("module_label", "gene", "loading", "ord")), "gene")
    genes = estimable(every, minimum_genes).withColumn("pos", F.dense_rank().over(W.partitionBy("module_label").orderBy("ord")) - 1)
    sizes = genes.groupBy("module_label").agg((F.max("pos") + 1).alias("n")).join(places, "module_label").select("module_label", "n", F.col("split_half_seed").alias("seed"))
    halves = resampling.split_half(genes, resampling.permutation_streams(sizes, repeats))
    table = inference.reliability_table(halves, every, weights, minimum_genes, positions=places).join(places.select("module_label", "position"), "module_label")
    single = resampling.leave_one_out(genes, minimum_genes).join(weights.select("module_label", "gene", "ord"), ["module_label", "gene"]).join(places.select("module_label", "position"), "module_label")
    return (
        table.orderBy("position").select("module_label", "n_common_genes", "split_half_median", "split_half_q05", "split_half_q95", "split_half_valid_repeats", "minimum_gene_loo_correlation", "median_gene_loo_correlation", "split_half_seed"),
        single.orderBy("position", "ord").select("module_label", F.col("gene").alias("left_out_gene"), "n_genes_remaining", "correlation_with_full_score"),
    )
