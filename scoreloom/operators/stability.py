"""Stability under resampling of samples and genes: models, clusters, panels and components.

Schedules are tables (rep, sample_id), joined to the rows; each repeat is a group of its own, so repeats run
side by side and a group holds one cohort's rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import finite, safe_corr
from scoreloom.operators.models import cox
from scoreloom.operators.recurrence import part_modules
from scoreloom.operators.sets import overlap
from scoreloom.sources.shared import written


def stratified_draws(rows: DataFrame, item: str, stratum: str, repeats: int, seed: int) -> DataFrame:
    """(rep, item): as many draws with replacement as a stratum has rows, from that stratum, by hash of (seed, rep, place)."""
    placed = rows.select(item, stratum).withColumns({"_pos": F.row_number().over(W.partitionBy(stratum).orderBy(item)) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(stratum))})
    draws = placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draws = draws.select(stratum, "rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "_pos", stratum), F.col("_n")).alias("_at"))
    return draws.join(placed.select(stratum, F.col("_pos").cast("bigint").alias("_at"), item), [stratum, "_at"]).select("rep", item)


def bootstrap_cox(rows: DataFrame, item: str, time: str, event: str, score: str, repeats: int = 200, seed: int = 42) -> DataFrame:
    """One row: repeats with a fit, median and 95 % interval of the coefficient, and the share above 0."""
    draws = stratified_draws(rows, item, event, repeats, seed)
    fits = cox(draws.join(rows.select(item, time, event, score), item), time, event, score, "rep").withColumn("b", F.col("coef"))
    return fits.filter("b is not null").agg(F.count("b").alias("repeats"), F.median("b").alias("median"), F.percentile("b", F.lit(0.025)).alias("low"), F.percentile("b", F.lit(0.975)).alias("high"), F.avg((F.col("b") > 0).cast("double")).alias("share_positive"))


def leave_one_out_cox(rows: DataFrame, item: str, time: str, event: str, score: str) -> DataFrame:
    """One row: fits without each sample in turn, their smallest and largest coefficient, and whether the sign holds.

    n samples give n fits of n - 1 rows: a cohort of hundreds, never a corpus.
    """
    left = rows.select(F.col(item).alias("_left"))
    kept = rows.select(item, time, event, score).join(left, F.col(item) != F.col("_left"))
    fits = cox(kept, time, event, score, "_left").withColumn("b", F.col("coef"))
    return fits.agg(F.count("b").alias("n_fits"), F.min("b").alias("smallest"), F.max("b").alias("largest"), (F.signum(F.min("b")) == F.signum(F.max("b"))).alias("sign_holds"))


def subsamples(items: DataFrame, item: str, repeats: int, share: float, seed: int) -> list[Column]:
    """Of each repeat, whether an item is among the share that comes first by hash of (seed, repeat, item), ties by the item.

    The last one in is found without an order of all: hashes are counted in slots of equal width, and only the slot in
    which it lies is ordered. One row of a repeat comes to the driver.
    """
    items = written(items.select(item), "items")
    least = math.ceil(share * items.count())
    hashed = items.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("h", F.xxhash64(F.lit(seed), "rep", item))
    hashed = hashed.withColumn("slot", F.shiftright("h", 52))
    upto = hashed.groupBy("rep", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("u", F.sum("n").over(W.partitionBy("rep").orderBy("slot")))
    at = upto.filter((F.col("u") >= least) & (F.col("u") - F.col("n") < least)).select("rep", "slot", (least - F.col("u") + F.col("n")).alias("nth"))
    last = hashed.join(F.broadcast(at), ["rep", "slot"]).withColumn("k", F.row_number().over(W.partitionBy("rep").orderBy("h", item))).filter("k = nth").select("rep", "h", item)
    bounds = {r["rep"]: (r["h"], r[item]) for r in last.collect()}

    def first(rep: int) -> Column:
        if rep not in bounds:
            return F.lit(False)
        h, (most, name) = F.xxhash64(F.lit(seed), F.lit(rep), item), bounds[rep]
        return (h < most) | ((h == most) & (F.col(item) <= F.lit(name)))

    return [first(k) for k in range(repeats)]


def subsample_modules(z: DataFrame, frozen: DataFrame, repeats: int, share: float, cut_correlation: float, least_genes: int = 5, seed: int = 42) -> DataFrame:
    """Modules found anew in shares of a cohort's samples, against the frozen ones: per module the repeats with a
    match, the mean and median of the best Jaccard index, and the mean of the best F1.

    `z`: sample_id, gene, z of one cohort; `frozen`: module_label, gene.
    """
    inside = subsamples(z.select("sample_id").distinct(), "sample_id", repeats, share, seed)
    found = part_modules(z.withColumn("cohort", F.lit("")), inside, cut_correlation, least_genes).filter("module_id > 0").select(F.concat_ws("/", "part", "module_id").alias("module"), "gene")
    both = overlap(frozen, found, "module_label", "module", "gene").withColumn("rep", F.substring_index("module", "/", 1))
    best = both.groupBy("module_label", "rep").agg(F.max("jaccard").alias("jaccard"), F.max("f1").alias("f1"))
    every = frozen.select("module_label").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("rep", F.col("rep").cast("string"))
    rows = every.join(best, ["module_label", "rep"], "left").withColumns({"matched": F.col("f1").isNotNull(), "jaccard": F.coalesce("jaccard", F.lit(0.0)), "f1": F.coalesce("f1", F.lit(0.0))})
    return rows.groupBy("module_label").agg(F.count(F.when(F.col("matched"), 1)).alias("n_matched"), F.avg("jaccard").alias("mean_jaccard"), F.median("jaccard").alias("median_jaccard"), F.avg("f1").alias("mean_f1"))


def rediscovery_null(found: DataFrame, frozen: DataFrame, panels: DataFrame) -> DataFrame:
    """Best F1 of each frozen module among the found ones, with the p value of the largest best F1 of random panels.

    `found`: module, gene; `frozen`: module_label, gene; `panels`: module_label, panel, gene. A panel's statistic
    is its maximum over all found modules, and a repeat's the maximum over its panels: p is corrected for both.
    """
    best = overlap(frozen, found, "module_label", "module", "gene").groupBy("module_label").agg(F.max("f1").alias("f1"))
    named = panels.select(F.concat_ws("/", "panel", "module_label").alias("name"), "gene")
    null = overlap(named, found, "name", "module", "gene").groupBy(F.substring_index("name", "/", 1).alias("panel")).agg(F.max("f1").alias("v"))
    every = panels.select(F.col("panel").cast("string").alias("panel")).distinct().join(null, "panel", "left").select(F.coalesce("v", F.lit(0.0)).alias("v"))
    rows = frozen.select("module_label").distinct().join(best, "module_label", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    # modules are a handful, so each meets every panel's one number
    return rows.crossJoin(every).groupBy("module_label", "f1").agg(F.count(F.lit(1)).alias("n_panels"), ((F.count(F.when(F.col("v") >= F.col("f1"), 1)) + 1) / (F.count(F.lit(1)) + 1.0)).alias("p_value"))


def component_scores(genes: DataFrame, cohort: str, anchor: str | None = None, without: DataFrame | None = None) -> DataFrame:
    """First singular vector of uncentred z per module as sample scores, standardised: module_label, sample_id, score.

    `without` (column gene) leaves those genes out, for programs disjoint from another one.

    It is turned so that it goes with the frozen signed mean, or with the anchor gene where one is given.
    Modules of fewer than two genes have missing scores.
    """

    def work(group: pa.Table) -> pa.Table:
        frame = group.to_pandas()
        x = frame.pivot(index="sample_id", columns="ord", values="z").sort_index(axis=1)
        info = frame.drop_duplicates("ord").set_index("ord").loc[x.columns]
        v = x.to_numpy()
        score = np.full(len(v), np.nan)
        if v.shape[1] >= 2 and len(v) >= 5:
            u, s, _ = np.linalg.svd(v, full_matrices=False)
            score = u[:, 0] * s[0]
            own = (info["gene"] == anchor).to_numpy()
            guide = v[:, own].mean(axis=1) if own.any() else v @ np.where(info["loading"] < 0, -1.0, 1.0)
            score = score if np.corrcoef(score, guide)[0, 1] >= 0 else -score
            score = (score - score.mean()) / score.std(ddof=1)
        return pa.table({"module_label": [frame["module_label"].iloc[0]] * len(v), "sample_id": x.index.tolist(), "score": pa.array(score, from_pandas=True)})

    some = genes if without is None else genes.join(without.select("gene").distinct(), "gene", "left_anti")
    return some.filter(F.col("cohort") == cohort).groupBy("module_label").applyInArrow(work, "module_label string, sample_id string, score double")


def risk_multipliers(associations: DataFrame, endpoints: tuple[str, ...] = ("DFI", "OS")) -> DataFrame:
    """(module_label, endpoint, coefficient, multiplier) of each module: the first endpoint with a finite coefficient, and its sign.

    `associations`: module_label, endpoint, coef, hazard_ratio, p_value. Of several rows of an endpoint the one with the smallest p
    counts, missing ones last; a missing coefficient is the logarithm of its hazard ratio.
    """
    rank = F.create_map(*[x for i, e in enumerate(endpoints) for x in (F.lit(e), F.lit(i))])[F.upper("endpoint")]
    best = W.partitionBy("module_label", "_rank").orderBy(finite(F.col("p_value")).asc_nulls_last(), "coef", "hazard_ratio")
    rows = associations.withColumn("_rank", rank).filter("_rank is not null").withColumn("_k", F.row_number().over(best)).filter("_k = 1")
    rows = rows.withColumn("coefficient", F.coalesce(finite(F.col("coef")), F.when(F.col("hazard_ratio") > 0, finite(F.ln(finite(F.col("hazard_ratio")))))))
    first = rows.filter("coefficient is not null").groupBy("module_label").agg(F.min(F.struct("_rank", F.upper("endpoint").alias("endpoint"), "coefficient")).alias("b"))
    return first.select("module_label", "b.endpoint", "b.coefficient", F.when(F.col("b.coefficient") < 0, -1.0).otherwise(1.0).alias("multiplier"))


def oriented_weights(genes: DataFrame, cohort: str, scores: DataFrame, associations: DataFrame) -> DataFrame:
    """Weights built per module, turned in two stages: module_label, gene, ord, raw_loading, risk_loading, score_correlation, endpoint.

    First the loadings follow the module's score (`scores`: module_label, sample_id, score): they are turned where the component's
    scores go against it; a module without one keeps its direction. Then towards risk, by `risk_multipliers`; a
    module without a fit keeps the first stage's direction.
    """
    from scoreloom.operators.preservation import leading_component

    loads = leading_component(genes, cohort)
    z = genes.filter(F.col("cohort") == cohort).select("module_label", "sample_id", "gene", "z")
    own = z.join(loads.select("module_label", "gene", "pc1"), ["module_label", "gene"]).groupBy("module_label", "sample_id").agg(F.sum(F.col("z") * F.col("pc1")).alias("component"))
    r = own.join(scores.select("module_label", "sample_id", "score"), ["module_label", "sample_id"]).groupBy("module_label").agg(safe_corr("component", "score").alias("score_correlation"))
    rows = loads.join(r, "module_label", "left").join(risk_multipliers(associations), "module_label", "left")
    raw = F.col("pc1") * F.when(F.col("score_correlation") < 0, -1.0).otherwise(1.0)
    return rows.select("module_label", "gene", "ord", raw.alias("raw_loading"), (raw * F.coalesce("multiplier", F.lit(1.0))).alias("risk_loading"), "score_correlation", "endpoint")
