"""Null distributions of a program: permuted gene labels and matched random gene panels.

Panels are drawn as sets: in each bin of similar genes the module's genes take the first of the
candidates in a pseudo-random order of the panel's own, so no draw waits for another. What a bin can't give is
taken from all candidates left. Gene correlations are partial sums over blocks of samples, one table of pairs
for all panels; a panel's edges are gathered from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import average_rank, benjamini_hochberg, percent_rank_average, quantile_bins, safe_corr, spearman
from scoreloom.operators import moments
from scoreloom.operators.recurrence import sign_concordance
from scoreloom.operators.resampling import centred_rank, permuted_edges, permuted_loadings
from scoreloom.operators.scoring import sign
from scoreloom.sources.shared import written

#: Samples to a block and genes to a tile of the correlation sums: some 30 MB a task.
SAMPLES = 4096
TILE = 512


# ---- permuted labels --------------------------------------------------------------------------------


def permutation_summary(observed: DataFrame, null: DataFrame, name: str) -> DataFrame:
    """Spearman of `observed` (module_label, total, norm) among permuted totals (module_label, rep, value): one- and two-sided p, mean and 95 % quantile of the null.

    Totals are exact sums of products of centred ranks, and a permutation keeps the norm, so ties are ties.
    """
    n, v, t = F.count(F.lit(1)), F.col("value"), F.col("total")
    share = v / F.nullif(F.col("norm"), F.lit(0.0))
    return null.join(observed, "module_label").groupBy("module_label").agg(
        F.max(t / F.nullif(F.col("norm"), F.lit(0.0))).alias(f"{name}_spearman"), n.alias(f"{name}_permutations"),
        ((F.count(F.when(v >= t, 1)) + 1) / (n + 1)).alias(f"{name}_p_positive"), ((F.count(F.when(F.abs(v) >= F.abs(t), 1)) + 1) / (n + 1)).alias(f"{name}_p_two_sided"),
        F.avg(share).alias(f"{name}_null_mean"), F.percentile(share, F.lit(0.95)).alias(f"{name}_null_q95"),
    )


def _total(rows: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return rows.groupBy("module_label").agg(F.sum(x * y).alias("total"), F.sqrt(F.sum(x * x) * F.sum(y * y)).alias("norm"))


def cross_cohort_audit(edges: DataFrame, loadings: DataFrame, schedule: DataFrame, reference: str, external: str) -> DataFrame:
    """Per module: edges of both cohorts against permuted gene labels, loadings against shuffled ones, and shares of equal signs.

    `edges`: cohort, module_label, i, j (places from 0), r; `loadings`: module_label, pos, external, frozen;
    `schedule`: module_label, rep, pos, idx. A permutation moves rows and columns of the correlations together.
    """
    defined = edges.filter("r is not null")
    a = defined.filter(F.col("cohort") == reference).select("module_label", "i", "j", centred_rank("r", "module_label").alias("a"), F.col("r").alias("ra"))
    b = defined.filter(F.col("cohort") == external).select("module_label", "i", "j", centred_rank("r", "module_label").alias("b"), F.col("r").alias("rb"))
    both = a.join(b, ["module_label", "i", "j"])
    edge = permutation_summary(_total(both, "a", "b"), permuted_edges(a.withColumnRenamed("a", "rr"), b.withColumnRenamed("b", "re"), schedule), "edge")
    pearson = both.groupBy("module_label").agg(safe_corr("ra", "rb").alias("edge_pearson"))
    signs = sign_concordance(edges, reference, external).select("module_label", F.col("sign_concordance").alias("edge_sign_concordance"))
    ranked = loadings.select("module_label", "pos", centred_rank("external", "module_label").alias("re"), centred_rank("frozen", "module_label").alias("rf"), (F.signum("external") == F.signum("frozen")).alias("same"))
    load = permutation_summary(_total(ranked, "re", "rf"), permuted_loadings(ranked, schedule), "loading")
    same = ranked.groupBy("module_label").agg(F.avg(F.col("same").cast("double")).alias("loading_sign_concordance"))
    return edge.join(pearson, "module_label", "left").join(signs, "module_label", "left").join(load, "module_label", "left").join(same, "module_label", "left")


# ---- panels -----------------------------------------------------------------------------------------


def variability_bins(values: DataFrame, reference: str, external: str, bins: int) -> DataFrame:
    """(gene, bin): quantile bins of the mean of both cohorts' variance ranks, over genes that both have.

    `values`: cohort, gene, value. Windows here run over genes, never over samples.
    """
    by_gene = values.groupBy("gene").agg(*[F.var_samp(F.when(F.col("cohort") == c, F.col("value"))).alias(n) for n, c in (("a", reference), ("b", external))]).dropna().withColumn("_all", F.lit(0))
    mean = by_gene.withColumn("m", (percent_rank_average("a", "_all") + percent_rank_average("b", "_all")) / 2)
    return quantile_bins(mean.withColumn("k", average_rank("m", "_all")), "k", bins, "_all").select("gene", F.col("bin").cast("string").alias("bin"))


def expression_bins(values: DataFrame, bins: int) -> DataFrame:
    """(gene, bin): quantile bins of a gene's mean and of its sd, together ("3_1"); constant genes are left out.

    `values`: gene, value of one cohort.
    """
    stats = values.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).filter("s > 0").withColumn("_all", F.lit(0))
    both = quantile_bins(quantile_bins(stats, "m", bins, "_all", name="mb"), "s", bins, "_all", name="sb")
    return both.select("gene", F.concat_ws("_", "mb", "sb").alias("bin"))


def drawn_panels(binned: DataFrame, modules: DataFrame, panels: int, seed: int = 42, key: Column | None = None, within: bool = False) -> DataFrame:
    """(module_label, panel, target, gene): for each gene of a module (target) another one of its bin, all different.

    `binned`: gene, bin; `modules`: module_label, gene, ord. Candidates are the genes of no module, or with
    `within` those of other modules as well. `key` orders candidates (gene) of a (module_label, panel); by default a hash.
    """
    labels = [r["module_label"] for r in modules.select("module_label").distinct().collect()]
    numbers = F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))
    targets = modules.select("module_label", "gene", "ord").join(binned, "gene").withColumn("k", F.row_number().over(W.partitionBy("module_label", "bin").orderBy("ord")))
    pool = binned.withColumn("module_label", F.explode(F.array(*map(F.lit, labels)))).join(modules.select("module_label", "gene") if within else modules.select("gene").distinct(), ["module_label", "gene"] if within else "gene", "left_anti")
    key = F.xxhash64(F.lit(seed), "module_label", "panel", "gene") if key is None else key
    drawn = pool.withColumn("panel", numbers).withColumn("key", key)
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("module_label", "panel", "bin").orderBy("key", "gene")))
    asked = targets.withColumnRenamed("gene", "target").withColumn("panel", numbers)
    met = written(asked.join(drawn, ["module_label", "panel", "bin", "k"], "full"), "draws")
    found = met.filter("target is not null and gene is not null").select("module_label", "panel", "target", "gene")
    place = W.partitionBy("module_label", "panel")
    short = met.filter("gene is null").select("module_label", "panel", "target", F.row_number().over(place.orderBy("ord")).alias("n"))
    left = met.filter("target is null").select("module_label", "panel", "gene", F.row_number().over(place.orderBy("key", "gene")).alias("n"))
    return found.unionByName(short.join(left, ["module_label", "panel", "n"], "left").select("module_label", "panel", "target", "gene"))


def whole_panels(panels: DataFrame) -> DataFrame:
    """Panels in which every target has a gene; too few candidates leave none."""
    return panels.join(panels.filter("gene is null").select("module_label", "panel").distinct(), ["module_label", "panel"], "left_anti")


def gene_correlations(values: DataFrame) -> DataFrame:
    """Correlations of gene pairs a < b over samples that have both: cohort, a, b, r; NULL for a constant side.

    `values`: cohort, sample_id, gene, value. Blocks of samples and tiles of genes give partial sums by dense products.
    """
    return moments.correlations(moments.pair_sums(values, ["cohort"], "gene", samples=SAMPLES, tile=TILE), "cohort")


def panel_edges(panels: DataFrame, correlations: DataFrame, reference: str, external: str) -> DataFrame:
    """Edge Spearman of each panel between the cohorts, to 12 digits so that equal ones compare as equal: module_label, panel, value.

    `panels`: module_label, panel, gene; `correlations` as of `gene_correlations`.
    """
    both = correlations.groupBy("a", "b").agg(*[F.max(F.when(F.col("cohort") == c, F.col("r"))).alias(n) for n, c in (("ra", reference), ("rb", external))]).dropna()
    x = panels.select("module_label", "panel", F.col("gene").alias("a"))
    pairs = x.join(x.withColumnRenamed("a", "b"), ["module_label", "panel"]).filter("a < b").join(both, ["a", "b"])
    return spearman(pairs, "ra", "rb", "module_label", "panel").select("module_label", "panel", F.round("spearman", 12).alias("value"))


def signed_panels(panels: DataFrame, modules: DataFrame, seed: int = 42, key: Column | None = None) -> DataFrame:
    """Panels (module_label, panel, gene, sgn) whose genes carry the module's loading signs in a permuted order.

    `modules`: module_label, gene, ord, loading. `key` orders the targets of a (module_label, panel).
    """
    key = F.xxhash64(F.lit(seed), F.lit("sign"), "module_label", "panel", "target") if key is None else key
    own = modules.select("module_label", F.col("gene").alias("target"), sign(F.col("loading")).alias("sgn"), "ord")
    rows = panels.join(own, ["module_label", "target"]).withColumn("key", key)
    by = W.partitionBy("module_label", "panel")
    rows = rows.withColumns({"i": F.row_number().over(by.orderBy("ord")), "k": F.row_number().over(by.orderBy("key", "ord"))})
    return rows.select("module_label", "panel", "gene", "i").join(rows.select("module_label", "panel", F.col("k").alias("i"), "sgn"), ["module_label", "panel", "i"]).drop("i")


def signed_scores(z: DataFrame, panels: DataFrame) -> DataFrame:
    """Signed mean of z of each panel and sample: module_label, panel, sample_id, score."""
    return z.select("sample_id", "gene", "z").join(panels, "gene").groupBy("module_label", "panel", "sample_id").agg(F.avg(F.col("z") * F.col("sgn")).alias("score"))


def null_summary(observed: DataFrame, null: DataFrame, magnitude: bool = False) -> DataFrame:
    """Observed statistics (module_label, observed) among panels' (module_label, panel, value): n_panels, mean, median,
    5, 90 and 95 % quantiles, the observed percentile, p and its q over the modules.

    p counts values as large as the observed one; with `magnitude`, absolute ones.
    """
    v, o, n = F.col("value"), F.col("observed"), F.count("value")
    reach = F.abs(v) >= F.abs(o) if magnitude else v >= o
    known = F.max(o).isNotNull() & (n > 0)
    rows = observed.join(null, "module_label", "left").groupBy("module_label").agg(
        F.max(o).alias("observed"), n.alias("n_panels"), F.avg(v).alias("null_mean"), F.median(v).alias("null_median"), *[F.percentile(v, F.lit(q / 100)).alias(f"null_q{q:02d}") for q in (5, 90, 95)],
        F.when(known, F.count(F.when(v <= o, 1)) / F.nullif(n, F.lit(0))).alias("percentile"), F.when(known, (F.count(F.when(reach, 1)) + 1) / (n + 1)).alias("p_value"),
    )
    return benjamini_hochberg(rows.withColumn("_all", F.lit(0)), "p_value", "_all", order="module_label").drop("_all")
