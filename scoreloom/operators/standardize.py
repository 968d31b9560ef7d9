"""Within-cohort standardisation of long expression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import exact_median, finite
from scoreloom.functions.symbols import cleaned, keep_first, plain

def normalised(expr: DataFrame, how: str = "plain") -> DataFrame:
    """Clean gene names and keep the first column of each name in a sample.

    'plain' (scoring) keeps empty names; 'clean' (preservation) drops them.
    """
    named = expr.withColumn("gene", plain(F.col("gene")) if how == "plain" else cleaned(F.col("gene")))
    if how == "clean":
        named = named.filter("gene != ''")
    return keep_first(named, ["cohort", "sample_id", "gene"], "gene_ord")


def standardised(expr: DataFrame, infinite_is_missing: bool = True) -> DataFrame:
    """Adds `z`: median-imputed, centred and scaled within (cohort, gene); drops genes without variance.

    Each gene's facts are combined before the shuffle and sent to the rows, one row per cohort and gene; medians are
    only sought for genes that miss values.
    """
    keys = ["cohort", "gene"]
    value = finite(F.col("value")) if infinite_is_missing else F.when(F.isnan("value"), None).otherwise(F.col("value"))
    rows = expr.withColumn("value", value)
    n, k = F.count("value"), F.count(F.lit(1)) - F.count("value")
    facts = rows.groupBy(*keys).agg(n.alias("_n"), k.alias("_k"), F.avg("value").alias("_mean"), F.var_samp("value").alias("_var"), F.min("value").alias("_lo"), F.max("value").alias("_hi")).filter("_hi > _lo")
    middle = exact_median(rows.join(F.broadcast(facts.filter("_k > 0").select(*keys)), keys, "left_semi"), "value", *keys, name="_mid")
    facts = facts.join(F.broadcast(middle), keys, "left")
    n, k, gap = F.col("_n"), F.col("_k"), F.coalesce(F.col("_mid") - F.col("_mean"), F.lit(0.0))
    # the moments of n values and k times their median
    mean = F.col("_mean") + F.when(k > 0, gap * k / (n + k)).otherwise(0.0)
    square = (F.col("_var") * (n - 1) + F.when(k > 0, gap * gap * n * k / (n + k)).otherwise(0.0)) / (n + k - 1)
    facts = facts.select(*keys, "_mid", mean.alias("_mean"), F.sqrt(square).alias("_sd")).filter(~F.isnan("_sd") & ~F.isnan("_mean") & (F.abs("_mean") < F.lit(float("inf"))))
    filled = rows.join(F.broadcast(facts), keys).withColumn("value", F.coalesce("value", "_mid"))
    return filled.withColumn("z", (F.col("value") - F.col("_mean")) / F.col("_sd")).select(*expr.columns, "z")


def gene_statistics(expr: DataFrame) -> DataFrame:
    """Mean, median, sample SD and variance of each gene, combined before the shuffle where possible."""
    return expr.groupBy("cohort", "gene").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("variance"))


def varying_genes(expr: DataFrame) -> DataFrame:
    """Genes whose values vary."""
    return expr.groupBy("cohort", "gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("hi > lo").select("cohort", "gene")


def top_variance_genes(expr: DataFrame, n: int) -> DataFrame:
    """The n most variable genes of each cohort with their variance percentile; ties by name."""
    stats = gene_statistics(expr).select("cohort", "gene", "variance")
    part = W.partitionBy("cohort")
    ranked = stats.withColumns({"position": F.row_number().over(part.orderBy(F.desc("variance"), "gene")), "percentile": F.rank().over(part.orderBy("variance")) / F.count(F.lit(1)).over(part)})
    return ranked.filter(F.col("position") <= n)


def log_rule(expr: DataFrame) -> DataFrame:
    """log2(x + 1) for cohorts on a count-like scale: no negatives, and a maximum over 50 or median over 10.

    The diagnostics are one aggregate per cohort; the decision joins back on the cohort.
    """
    whole = F.abs(F.col("value") - F.rint("value")) <= 1e-8
    facts = expr.groupBy("cohort").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg(whole.cast("double")).alias("integer_like"))
    facts = facts.join(exact_median(expr, "value", "cohort", name="middle"), "cohort", "left").select("cohort", "lowest", "highest", "middle", "integer_like")
    facts = facts.withColumn("logged", (F.col("lowest") >= 0) & ((F.col("highest") > 50) | (F.col("middle") > 10)))
    return expr.join(F.broadcast(facts), "cohort").withColumn("value", F.when(F.col("logged"), F.log2(F.greatest(F.lit(0.0), F.col("value")) + 1)).otherwise(F.col("value")))
