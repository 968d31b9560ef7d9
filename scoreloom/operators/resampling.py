"""Permutation, split-half and leave-one-out inference. Schedules are data, so runs can be replayed."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import average_rank, empirical_p, safe_corr
from scoreloom.operators import moments
from scoreloom.operators.scoring import sign

#: Repeats of a module that one task takes together.
REPEATS = 256


def permutation_seeds(position: int, base: int = 42, stride: int = 100) -> tuple[int, int, int]:
    """Seeds of the edge, loading and split-half schedules of the module at this place."""
    if position < 0:
        raise ValueError("position must not be negative")
    return base + stride * position, base + stride * position + 1, base + stride * position + 2


def permutation_schedule(spark: SparkSession, sizes: dict[str, int], seeds: dict[str, int], repeats: int) -> DataFrame:
    """(module_label, rep, pos, idx): one sequential random stream per module, made once and then spread."""
    parts = []
    for label, n in sizes.items():
        rng = np.random.default_rng(seeds[label])
        perms = np.concatenate([rng.permutation(n) for _ in range(repeats)]) if n else np.zeros(0, np.int64)
        parts.append(pa.table({"module_label": [label] * len(perms), "rep": np.repeat(np.arange(repeats), n).astype(np.int32), "pos": np.tile(np.arange(n), repeats).astype(np.int32), "idx": perms.astype(np.int32)}))
    return spark.createDataFrame(pa.concat_tables(parts)) if parts else spark.createDataFrame([], "module_label string, rep int, pos int, idx int")


def permutation_streams(sizes: DataFrame, repeats: int, cells: int = 1 << 16) -> DataFrame:
    """The same schedule made in tasks: `sizes` has module_label, n and seed; a module's stream is drawn in order, some `cells` rows at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, n, seed in zip(*(b.column(c).to_pylist() for c in ("module_label", "n", "seed")), strict=True):
                rng, step = np.random.default_rng(seed), max(1, cells // max(n, 1))
                for at in range(0, repeats if n else 0, step):
                    k = min(step, repeats - at)
                    drawn = np.concatenate([rng.permutation(n) for _ in range(k)])
                    yield pa.record_batch({"module_label": pa.array([label] * len(drawn), pa.string()), "rep": np.repeat(np.arange(at, at + k), n).astype(np.int32), "pos": np.tile(np.arange(n), k).astype(np.int32), "idx": drawn.astype(np.int32)})

    return sizes.select("module_label", "n", "seed").repartition("module_label").mapInArrow(work, "module_label string, rep int, pos int, idx int")


def balanced_splits(n: int, limit: int = 12, repeats: int = 1000, seed: int = 42) -> list[tuple[int, ...]]:
    """First halves of n items: all of them for up to `limit` items, else `repeats` random ones."""
    if n <= limit:
        return list(itertools.combinations(range(n), n // 2))
    rng = np.random.default_rng(seed)
    return [tuple(sorted(rng.permutation(n)[: n // 2].tolist())) for _ in range(repeats)]


def split_summary(found: DataFrame) -> DataFrame:
    """Per module over splits: mean, median, exact 5 and 95 % quantiles, and the shares above 0 and 0.30."""
    r = F.col("r")
    return found.filter("r is not null").groupBy("module_label").agg(F.count("r").alias("n_splits"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.percentile("r", F.lit(0.05)).alias("q05"), F.percentile("r", F.lit(0.95)).alias("q95"), F.avg((r > 0).cast("double")).alias("share_positive"), F.avg((r > 0.30).cast("double")).alias("share_above_030"))


def centred_rank(value: str, *keys: str) -> Column:
    """Average rank minus its mean: quarters at most, so sums of products are exact and true ties stay ties."""
    return average_rank(value, *keys) - (F.count(F.lit(1)).over(W.partitionBy(*keys)) + 1) / F.lit(2.0)


def loading_permutation(pairs: DataFrame, schedule: DataFrame) -> DataFrame:
    """Counts |Spearman| of shuffled external loadings at least the observed one, per module.

    `pairs`: module_label, pos, external, frozen. Ranks are gathered by the schedule and never ranked again.
    """
    ranked = pairs.select("module_label", "pos", centred_rank("external", "module_label").alias("re"), centred_rank("frozen", "module_label").alias("rf"))
    observed = ranked.groupBy("module_label").agg(safe_corr("re", "rf").alias("observed"), F.abs(F.sum(F.col("re") * F.col("rf"))).alias("bound"))
    null = permuted_loadings(ranked, schedule).withColumn("value", F.abs("value"))
    return _counted(observed, null)


def permuted_loadings(ranked: DataFrame, schedule: DataFrame) -> DataFrame:
    """Sums of products of ranks (module_label, pos, re, rf) with `re` shuffled: module_label, rep, value."""
    shuffled = schedule.join(ranked.select("module_label", F.col("pos").alias("idx"), "re"), ["module_label", "idx"]).join(ranked.select("module_label", "pos", "rf"), ["module_label", "pos"])
    return shuffled.groupBy("module_label", "rep").agg(F.sum(F.col("re") * F.col("rf")).alias("value"))


def edge_permutation(edges: DataFrame, schedule: DataFrame, reference: str, external: str) -> DataFrame:
    """The same for gene labels: rows and columns of the external correlations are permuted together.

    Edges are in positions i < j from 0; a permuted edge takes the rank of the edge between the genes it
    is sent to. Work per module is repeats x edges, spread over (module, repeat).
    """
    a = edges.filter(F.col("cohort") == reference).select("module_label", "i", "j", centred_rank("r", "module_label").alias("rr"))
    b = edges.filter(F.col("cohort") == external).select("module_label", "i", "j", centred_rank("r", "module_label").alias("re"))
    observed = a.join(b, ["module_label", "i", "j"]).groupBy("module_label").agg(safe_corr("rr", "re").alias("observed"), F.abs(F.sum(F.col("rr") * F.col("re"))).alias("bound"))
    null = permuted_edges(a, b, schedule).withColumn("value", F.abs("value"))
    return _counted(observed, null)


def permuted_edges(a: DataFrame, b: DataFrame, schedule: DataFrame) -> DataFrame:
    """Sums of products of edge ranks `rr` of a and `re` of b (module_label, i, j), a's genes sent elsewhere: module_label, rep, value."""
    to = schedule.select("module_label", "rep", F.col("pos"), F.col("idx"))
    sent = a.join(to.select("module_label", "rep", F.col("pos").alias("i"), F.col("idx").alias("pi")), ["module_label", "i"]).join(to.select("module_label", "rep", F.col("pos").alias("j"), F.col("idx").alias("pj")), ["module_label", "rep", "j"])
    sent = sent.select("module_label", "rep", "rr", F.least("pi", "pj").alias("i"), F.greatest("pi", "pj").alias("j"))
    return sent.join(b, ["module_label", "i", "j"]).groupBy("module_label", "rep").agg(F.sum(F.col("rr") * F.col("re")).alias("value"))


def _counted(observed: DataFrame, null: DataFrame) -> DataFrame:
    hits = null.join(observed, "module_label").groupBy("module_label").agg(F.max("observed").alias("observed"), F.count(F.lit(1)).alias("n_permutations"), F.count(F.when(F.col("value") >= F.col("bound"), 1)).alias("extreme_count"))
    return hits.withColumn("p_value", F.when(F.col("observed").isNotNull(), empirical_p(F.col("extreme_count"), F.col("n_permutations"))))


def split_half(genes: DataFrame, schedule: DataFrame) -> DataFrame:
    """Correlation of the signed means of two halves of the genes, per module and repeat.

    `genes`: module_label, sample_id, pos, loading, z; one value of a sample and place. Places below n // 2 of a repeat form the first half.

    A half's mean is a weighted sum of genes, so its variance and the halves' covariance follow from the genes' sums of
    products: samples are read once, whatever the number of repeats. Modules in which some sample lacks a gene have
    other weights in that sample; their samples meet every repeat.
    """
    sizes = schedule.groupBy("module_label").agg((F.max("pos") + 1).alias("n"))
    halves = schedule.join(F.broadcast(sizes), "module_label").filter("n >= 4").select("module_label", "rep", F.col("idx").alias("pos"), (F.col("pos") < F.floor(F.col("n") / 2)).alias("first"))
    signed = genes.select("module_label", F.col("pos").cast("int").alias("pos"), "sample_id", (sign(F.col("loading")) * F.col("z")).alias("s"))
    sums = moments.pair_sums(signed, ["module_label"], "pos", "s")
    places = F.count(F.when(F.col("a") == F.col("b"), 1))
    whole = sums.groupBy("module_label").agg(((F.min("n") == F.max("n")) & (F.count(F.lit(1)) == places * (places + 1) / 2)).alias("whole"))
    part, rest = (F.broadcast(whole.filter(c).select("module_label")) for c in ("not whole", "whole"))
    means = halves.join(part, "module_label", "left_semi").join(signed.join(part, "module_label", "left_semi"), ["module_label", "pos"]).groupBy("module_label", "rep", "sample_id").agg(F.avg(F.when(F.col("first"), F.col("s"))).alias("a"), F.avg(F.when(~F.col("first"), F.col("s"))).alias("b"))
    met = means.groupBy("module_label", "rep").agg(safe_corr("a", "b").alias("r"))
    chunk = F.floor(F.col("rep") / REPEATS).cast("bigint").alias("chunk")
    left = halves.join(rest, "module_label", "left_semi").select("module_label", chunk, "rep", F.col("pos").cast("int").alias("pos"), "first")
    chunks = left.select("module_label", F.col("chunk").alias("_chunk")).distinct()
    right = sums.join(rest, "module_label", "left_semi").join(F.broadcast(chunks), "module_label").select(*sums.columns, F.col("_chunk").alias("chunk"))
    found = left.groupBy("module_label", "chunk").cogroup(right.groupBy("module_label", "chunk")).applyInArrow(_halves, "module_label string, rep bigint, r double")
    return found.withColumn("rep", F.col("rep").cast(dict(schedule.dtypes)["rep"])).unionByName(met)


def _halves(plan: pa.Table, sums: pa.Table) -> pa.Table:
    """Correlations of the halves of some repeats of a module."""
    shape = pa.schema([("module_label", pa.string()), ("rep", pa.int64()), ("r", pa.float64())])
    if not plan.num_rows or not sums.num_rows:
        return shape.empty_table()
    items, _, _, c = moments.square(sums)
    pos, rep, first = plan.column("pos").to_numpy(), plan.column("rep").to_numpy(), plan.column("first").to_numpy(zero_copy_only=False)
    known = np.isin(pos, items)
    pos, rep, first = np.searchsorted(items, pos[known]), rep[known], first[known]
    reps, row = np.unique(rep, return_inverse=True)
    u, v = np.zeros((len(reps), len(items))), np.zeros((len(reps), len(items)))
    np.add.at(u, (row[first], pos[first]), 1.0)
    np.add.at(v, (row[~first], pos[~first]), 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        u, v = u / u.sum(axis=1, keepdims=True), v / v.sum(axis=1, keepdims=True)
        uc, vc = u @ c, v @ c
        a, b, ab = (uc * u).sum(axis=1), (vc * v).sum(axis=1), (uc * v).sum(axis=1)
        sd = np.sqrt(np.diag(c))
        # what is left of genes that cancel each other is rounding noise
        some = (a > 1e-13 * (u @ sd) ** 2) & (b > 1e-13 * (v @ sd) ** 2)
        r = ab / np.sqrt(a * b)
    return pa.table({"module_label": [plan.column("module_label")[0].as_py()] * len(reps), "rep": reps.astype(np.int64), "r": pa.array(r, mask=~some)}, schema=shape)


def split_half_summary(found: DataFrame) -> DataFrame:
    """Median, exact 5 and 95 % quantiles and number of finite repeats."""
    return found.filter("r is not null").groupBy("module_label").agg(F.median("r").alias("split_half_median"), F.percentile("r", F.lit(0.05)).alias("split_half_q05"), F.percentile("r", F.lit(0.95)).alias("split_half_q95"), F.count("r").alias("split_half_valid_repeats"), F.avg((F.col("r") > 0).cast("double")).alias("split_half_fraction_positive"))


def leave_one_out(genes: DataFrame, minimum_genes: int = 3) -> DataFrame:
    """Correlation of the full score with the score without each gene, in closed form.

    With t the signed value and S their sum over genes, the score without g is (S - t_g) / (n - 1).
    """
    part = W.partitionBy("cohort", "module_label", "sample_id")
    t = genes.withColumn("t", sign(F.col("loading")) * F.col("z")).withColumns({"total": F.sum("t").over(part), "n": F.count(F.lit(1)).over(part)}).filter(F.col("n") > minimum_genes)
    return t.groupBy("cohort", "module_label", "gene").agg(F.max(F.col("n") - 1).alias("n_genes_remaining"), safe_corr(F.col("total") / F.col("n"), (F.col("total") - F.col("t")) / (F.col("n") - 1)).alias("correlation_with_full_score"))


def leave_one_out_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("cohort", "module_label").agg(F.min("correlation_with_full_score").alias("minimum_gene_loo_correlation"), F.median("correlation_with_full_score").alias("median_gene_loo_correlation"))


def sign_flip(differences: DataFrame, value: str, *keys: str, slack: float = 1e-12, flips: int = 100_000, most_exact: int = 20) -> DataFrame:
    """Two-sided sign-flip test of a mean per key: exact up to `most_exact` differences, beyond by random flips.

    Random signs are bits of a hash of (flip, place), so reruns agree; then p is (hits + 1) / (flips + 1).
    """
    n = F.size("_d")
    exact = n <= most_exact
    base = differences.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_d"))
    last = F.when(exact, F.pow(F.lit(2.0), F.least(n, F.lit(most_exact))).cast("int") - 1).otherwise(flips - 1)
    flipped = base.withColumns({"_obs": F.abs(F.aggregate("_d", F.lit(0.0), lambda a, x: a + x)) / n, "_k": F.explode(F.sequence(F.lit(0), last))})
    minus = lambda i: F.when(exact, F.floor(F.col("_k") / F.pow(F.lit(2.0), i)) % 2 == 1).otherwise(F.pmod(F.xxhash64("_k", i), F.lit(2)) == 1)
    mean = F.aggregate(F.transform("_d", lambda x, i: F.when(minus(i), -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x) / n
    hits = flipped.withColumns({"_hit": (F.abs(mean) >= F.col("_obs") - slack).cast("double"), "_one": exact.cast("int")}).groupBy(*keys).agg(F.sum("_hit").alias("_h"), F.count(F.lit(1)).alias("_c"), F.max("_one").alias("_e"), F.max(F.size("_d")).alias("n_pairs"))
    p = F.when(F.col("_e") == 1, F.col("_h") / F.col("_c")).otherwise((F.col("_h") + 1) / (F.col("_c") + 1))
    return hits.select(*keys, p.alias("p_value"), "n_pairs")
