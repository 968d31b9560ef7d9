"""Frozen program scores: coverage, signed mean and weighted score, without any look at outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import z_score
from scoreloom.functions.symbols import NULL_TOKENS, keep_first, plain
from scoreloom.schemas import ScoringRule, require_columns


def frozen_program(weights: DataFrame) -> DataFrame:
    """Cleaned weights: upper-case symbols, no null tokens ('NA' is a symbol here), first of each symbol."""
    require_columns(weights, "module_label", "gene", "loading", "ord")
    named = weights.withColumn("gene", plain(F.col("gene"))).filter(~F.coalesce("gene", F.lit("")).isin(*[t for t in NULL_TOKENS if t != "NA"]))
    return keep_first(named, ["module_label", "gene"], "ord")


def module(weights: DataFrame, label: str) -> DataFrame:
    """Rows of one module; raises if there are none."""
    found = weights.filter(F.col("module_label").cast("string") == label)
    if not found.take(1):
        raise ValueError(f"no weights for module {label}")
    return found


def sign(loading: Column) -> Column:
    """-1 for negative loadings, else +1 (0 counts as positive)."""
    return F.when(loading < 0, -1.0).otherwise(1.0)


def joined(items: Column) -> Column:
    """Genes of (ord, gene) structs in file order, ;-joined."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["gene"]), ";")


def coverage(expr: DataFrame, z: DataFrame, weights: DataFrame, rule: ScoringRule = ScoringRule()) -> DataFrame:
    """One row per cohort and module: counts, fraction, gene lists and whether the module can be scored.

    Genes count as available when the expression table has them, before the variance filter.
    """
    cohorts = expr.select("cohort").distinct()
    wanted = cohorts.crossJoin(F.broadcast(weights))  # a frozen weight table has a fixed size
    have = expr.select("cohort", "gene").distinct().withColumn("_have", F.lit(1))
    kept = z.select("cohort", "gene").distinct().withColumn("_z", F.lit(1))
    rows = wanted.join(have, ["cohort", "gene"], "left").join(kept, ["cohort", "gene"], "left")
    item = F.struct("ord", "gene")
    out = rows.groupBy("cohort", "module_label").agg(
        F.count(F.lit(1)).alias("n_frozen_genes"), F.count("_have").alias("n_available_genes"), F.count("_z").alias("n_scored_genes"),
        joined(F.collect_list(F.when(F.col("_have").isNotNull(), item))).alias("available_genes"), joined(F.collect_list(F.when(F.col("_have").isNull(), item))).alias("missing_genes"),
    )
    fraction = F.col("n_available_genes") / F.col("n_frozen_genes")
    passed = (F.col("n_available_genes") >= rule.minimum_genes) & (fraction >= rule.minimum_fraction)
    return out.withColumns({"coverage_fraction": fraction, "minimum_rule_passed": passed, "estimable": passed & (F.col("n_scored_genes") >= rule.minimum_genes)})


def raw_scores(z: DataFrame, weights: DataFrame) -> DataFrame:
    """Per cohort, module and sample: mean of signed z, and z weighted by available loadings."""
    rows = z.select("cohort", "sample_id", "gene", "z").join(weights.select("module_label", "gene", "loading"), "gene")
    total = F.sum(F.abs("loading"))
    return rows.groupBy("cohort", "module_label", "sample_id").agg(F.avg(sign(F.col("loading")) * F.col("z")).alias("signed_mean"), (F.sum(F.col("loading") * F.col("z")) / F.nullif(total, F.lit(0.0))).alias("weighted"))


def scores(expr: DataFrame, z: DataFrame, weights: DataFrame, rule: ScoringRule = ScoringRule()) -> DataFrame:
    """Standardised scores of the modules that pass the rule, long: cohort, module_label, score_name, sample_id, value."""
    good = coverage(expr, z, weights, rule).filter("estimable").select("cohort", "module_label")
    raw = raw_scores(z, weights).join(good, ["cohort", "module_label"], "left_semi")
    long = raw.unpivot(["cohort", "module_label", "sample_id"], ["signed_mean", "weighted"], "score_name", "raw")
    part = W.partitionBy("cohort", "module_label", "score_name")
    return long.withColumn("value", z_score(F.col("raw"), part)).drop("raw")


def wide_scores(long: DataFrame, mapping: str, modules: list[str]) -> DataFrame:
    """One row per cohort and sample, columns {module}__{mapping}__{score}."""
    names = {"signed_mean": "signed_mean_z", "weighted": "canine_pca_weighted_z"}
    columns = [f"{m}__{mapping}__{n}" for m in modules for n in names.values()]
    label = F.concat_ws("__", "module_label", F.lit(mapping), F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("score_name")))
    return long.withColumn("_c", label).groupBy("cohort", "sample_id").pivot("_c", columns).agg(F.first("value"))


def components(z: DataFrame, weights: DataFrame) -> DataFrame:
    """Positive, negative and signed parts of the weighted score, weights normalised by all loadings."""
    rows = z.select("cohort", "sample_id", "gene", "z").join(weights.select("module_label", "gene", "loading"), "gene")
    part, total = F.col("loading") * F.col("z"), F.nullif(F.sum(F.abs("loading")), F.lit(0.0))
    return rows.groupBy("cohort", "module_label", "sample_id").agg(
        (F.sum(F.when(F.col("loading") > 0, part).otherwise(0.0)) / total).alias("positive"), (F.sum(F.when(F.col("loading") < 0, part).otherwise(0.0)) / total).alias("negative"), (F.sum(part) / total).alias("signed"))
