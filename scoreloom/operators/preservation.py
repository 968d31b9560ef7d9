"""Whether a program's correlations and leading component survive in another cohort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.stats import safe_corr, spearman
from scoreloom.operators import moments
from scoreloom.operators.scoring import joined, sign


def module_genes(z: DataFrame, weights: DataFrame) -> DataFrame:
    """Standardised values of module genes that both cohorts have: cohort, module_label, sample_id, gene, ord, loading, z."""
    rows = z.select("cohort", "sample_id", "gene", "z").join(weights.select("module_label", "gene", "loading", "ord"), "gene")
    both = rows.groupBy("module_label", "gene").agg(F.count_distinct("cohort").alias("n")).filter("n = 2")
    return rows.join(both.select("module_label", "gene"), ["module_label", "gene"], "left_semi")


def coverage(z: DataFrame, weights: DataFrame, external: str, minimum_genes: int = 3) -> DataFrame:
    """Common genes per module; genes that only the reference lacks are not listed as missing."""
    seen = z.groupBy("gene").agg(F.max((F.col("cohort") == external).cast("int")).alias("ext"), F.max((F.col("cohort") != external).cast("int")).alias("ref"))
    rows = weights.join(seen, "gene", "left")
    common = (F.coalesce("ext", F.lit(0)) == 1) & (F.coalesce("ref", F.lit(0)) == 1)
    item = F.struct("ord", "gene")
    out = rows.groupBy("module_label").agg(F.count(F.lit(1)).alias("n_frozen_genes"), F.count(F.when(common, 1)).alias("n_common_genes"), joined(F.collect_list(F.when(common, item))).alias("common_genes"), joined(F.collect_list(F.when(F.coalesce("ext", F.lit(0)) == 0, item))).alias("missing_external_genes"))
    ok = F.col("n_common_genes") >= minimum_genes
    return out.withColumns({"coverage_fraction": F.col("n_common_genes") / F.col("n_frozen_genes"), "estimable": ok, "nonestimable_reason": F.when(~ok, f"fewer_than_{minimum_genes}_common_genes").otherwise("")})


def edges(genes: DataFrame) -> DataFrame:
    """Correlations of gene pairs i < j by a join on the sample: cohort, module_label, i, j, r.

    Rows grow with the square of a module's size; modules of thousands of genes go by `edges_by_matrix`.
    """
    a = genes.select("cohort", "module_label", "sample_id", F.col("ord").alias("i"), F.col("z").alias("zi"))
    b = genes.select("cohort", "module_label", "sample_id", F.col("ord").alias("j"), F.col("z").alias("zj"))
    pairs = a.join(b, ["cohort", "module_label", "sample_id"]).filter("i < j")
    return pairs.groupBy("cohort", "module_label", "i", "j").agg(safe_corr("zi", "zj").alias("r"))


def edges_by_matrix(genes: DataFrame) -> DataFrame:
    """The same by dense products of blocks of samples, in parts of `moments`."""
    sums = moments.pair_sums(genes, ["cohort", "module_label"], "ord", "z")
    return moments.correlations(sums, "cohort", "module_label").select("cohort", "module_label", F.col("a").alias("i"), F.col("b").alias("j"), "r")


def edge_preservation(found: DataFrame, reference: str, external: str) -> DataFrame:
    """Spearman correlation of the two cohorts' edges, per module."""
    a = found.filter(F.col("cohort") == reference).select("module_label", "i", "j", F.col("r").alias("r_ref"))
    b = found.filter(F.col("cohort") == external).select("module_label", "i", "j", F.col("r").alias("r_ext"))
    return spearman(a.join(b, ["module_label", "i", "j"]), "r_ref", "r_ext", "module_label")


def leading_component(genes: DataFrame, cohort: str) -> DataFrame:
    """Loadings of the first principal component per module, turned towards the frozen signed mean.

    From the genes' sums of products over all samples, a small symmetric matrix per module; long output:
    module_label, gene, ord, pc1, frozen_loading, variance_explained, orientation_correlation.
    """
    own = genes.filter(F.col("cohort") == cohort)
    named = own.groupBy("module_label", "ord").agg(F.first("gene").alias("gene"), F.first("loading").alias("loading"))
    sums = moments.pair_sums(own, ["module_label"], "ord", "z").join(named.select("module_label", F.col("ord").alias("a"), "gene", "loading"), ["module_label", "a"])

    def work(group: pa.Table) -> pa.Table:
        items, _, _, c = moments.square(group)
        at = group.filter(pa.compute.equal(group.column("a"), group.column("b"))).sort_by("a")
        values, vectors = np.linalg.eigh(c)
        values, load = np.maximum(values, 0), vectors[:, -1].copy()
        w = np.where(at.column("loading").to_numpy(zero_copy_only=False) < 0, -1.0, 1.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = float(np.clip(load @ c @ w / np.sqrt((load @ c @ load) * (w @ c @ w)), -1, 1))
        if r < 0:
            load, r = -load, -r
        n = len(load)
        return pa.table({"module_label": [group.column("module_label")[0].as_py()] * n, "gene": at.column("gene"), "ord": items.astype(np.int32), "pc1": load, "frozen_loading": at.column("loading"), "variance_explained": np.full(n, values[-1] / values.sum()), "orientation_correlation": np.full(n, r)})

    return sums.groupBy("module_label").applyInArrow(work, "module_label string, gene string, ord int, pc1 double, frozen_loading double, variance_explained double, orientation_correlation double")


def loading_preservation(pc1: DataFrame) -> DataFrame:
    """Spearman correlation of external and frozen loadings, per module."""
    return spearman(pc1, "pc1", "frozen_loading", "module_label")


def frozen_signed_mean(genes: DataFrame) -> DataFrame:
    """Signed mean of z, not standardised again: cohort, module_label, sample_id, score."""
    return genes.groupBy("cohort", "module_label", "sample_id").agg(F.avg(sign(F.col("loading")) * F.col("z")).alias("score"))
