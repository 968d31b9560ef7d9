"""Full inference and reliability tables, paired contrasts and signed-rank tests.

A module's null values need its own random stream in order, so a module is one task; it holds the module's
edges (hundreds of genes squared at the most), never samples or the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import average_rank, benjamini_hochberg, empirical_p, normal_tail, safe_corr
from scoreloom.operators.outcomes import contrast_tier
from scoreloom.operators.preservation import edge_preservation, loading_preservation
from scoreloom.operators.resampling import centred_rank, leave_one_out, leave_one_out_summary, permutation_seeds, split_half_summary


def edge_counts(edges: DataFrame, positions: DataFrame, reference: str, external: str, repeats: int) -> DataFrame:
    """How often |Spearman| of edges under permuted gene labels reaches the observed one: module_label, count.

    Centred ranks are multiples of a half, so sums of their products are exact and true ties stay ties.
    """
    a = edges.filter(F.col("cohort") == reference).select("module_label", "i", "j", F.col("r").alias("ra"))
    b = edges.filter(F.col("cohort") == external).select("module_label", "i", "j", F.col("r").alias("rb"))
    both = a.join(b, ["module_label", "i", "j"]).filter("ra is not null and rb is not null")
    ranked = both.select("module_label", "i", "j", centred_rank("ra", "module_label").alias("a"), centred_rank("rb", "module_label").alias("b"))

    def work(group: pa.Table) -> pa.Table:
        i, j, a, b = (group.column(c).to_numpy() for c in ("i", "j", "a", "b"))
        names, inverse = np.unique(np.concatenate((i, j)), return_inverse=True)
        n, at = len(names), inverse.reshape(2, -1)
        square = np.zeros((n, n))
        square[at[0], at[1]] = square[at[1], at[0]] = b
        rng, bound, hits = np.random.default_rng(group.column("seed")[0].as_py()), abs(float(a @ b)), 0
        for _ in range(repeats):
            p = rng.permutation(n)
            hits += abs(float(a @ square[p[at[0]], p[at[1]]])) >= bound
        return pa.table({"module_label": [group.column("module_label")[0].as_py()], "edge_extreme_count": pa.array([hits], pa.int64())})

    return ranked.join(F.broadcast(positions.selectExpr("module_label", "edge_seed as seed")), "module_label").groupBy("module_label").applyInArrow(work, "module_label string, edge_extreme_count bigint")


def loading_counts(loadings: DataFrame, positions: DataFrame, repeats: int) -> DataFrame:
    """The same for shuffled external loadings."""
    ranked = loadings.select("module_label", "ord", centred_rank("pc1", "module_label").alias("a"), centred_rank("frozen_loading", "module_label").alias("b"))

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("ord")
        a, b = group.column("a").to_numpy(), group.column("b").to_numpy()
        rng, bound = np.random.default_rng(group.column("seed")[0].as_py()), abs(float(a @ b))
        hits = sum(abs(float(rng.permutation(a) @ b)) >= bound for _ in range(repeats))
        return pa.table({"module_label": [group.column("module_label")[0].as_py()], "loading_extreme_count": pa.array([hits], pa.int64())})

    return ranked.join(F.broadcast(positions.selectExpr("module_label", "loading_seed as seed")), "module_label").groupBy("module_label").applyInArrow(work, "module_label string, loading_extreme_count bigint")


def module_positions(weights: DataFrame, base: int = 42) -> DataFrame:
    """Modules in the order of their first weight, with the seeds of their streams."""
    first = weights.filter("module_label is not null").groupBy("module_label").agg(F.min("ord").alias("first"))
    place = F.row_number().over(W.orderBy("first", "module_label")) - 1
    return seeded(first.select("module_label", place.alias("position")), base)


def seeded(places: DataFrame, base: int = 42, stride: int = 100) -> DataFrame:
    """Adds the seeds of the edge, loading and split-half streams of modules at these places."""
    return places.withColumns({n: (F.col("position") * stride + s).cast("bigint") for n, s in zip(("edge_seed", "loading_seed", "split_half_seed"), permutation_seeds(0, base, stride), strict=True)})


def inference_table(edges: DataFrame, loadings: DataFrame, genes: DataFrame, weights: DataFrame, reference: str, external: str, repeats: int = 5000, minimum_genes: int = 3, base: int = 42, positions: DataFrame | None = None) -> DataFrame:
    """One row per module: both statistics with counts, p, seeds and q values of the joint family.

    The family holds the edge and the loading test of every module with a p value. `positions`: places and seeds of a
    run's own list of modules, else they follow the weights.
    """
    positions = module_positions(weights, base) if positions is None else positions
    counts = genes.groupBy("module_label").agg(F.count_distinct("gene").alias("n_common_genes"))
    rows = positions.join(counts, "module_label", "left").withColumn("n_common_genes", F.coalesce("n_common_genes", F.lit(0)))
    for part in (edge_preservation(edges, reference, external).withColumnRenamed("spearman", "edge_spearman"), loading_preservation(loadings).withColumnRenamed("spearman", "loading_spearman"), edge_counts(edges, positions, reference, external, repeats), loading_counts(loadings, positions, repeats)):
        rows = rows.join(part, "module_label", "left")
    enough = F.col("n_common_genes") >= minimum_genes
    for k in ("edge", "loading"):
        ok = enough & F.col(f"{k}_spearman").isNotNull()
        rows = rows.withColumns({f"{k}_extreme_count": F.when(ok, F.col(f"{k}_extreme_count")).otherwise(F.lit(0)), f"{k}_permutation_p": F.when(ok, empirical_p(F.col(f"{k}_extreme_count"), repeats))})
    long = rows.select("module_label", F.col("edge_permutation_p").alias("edge"), F.col("loading_permutation_p").alias("loading"), "position").unpivot(["module_label", "position"], ["edge", "loading"], "kind", "p")
    long = long.withColumns({"o": 2 * F.col("position") + (F.col("kind") == "loading").cast("int"), "all": F.lit(1)})
    q = benjamini_hochberg(long, "p", "all", order="o", size="direct_permutation_family_size")
    q = q.groupBy("module_label").agg(F.max(F.when(F.col("kind") == "edge", F.col("q_value"))).alias("edge_q_bh_8"), F.max(F.when(F.col("kind") == "loading", F.col("q_value"))).alias("loading_q_bh_8"), F.max("direct_permutation_family_size").alias("direct_permutation_family_size"))
    rows = rows.join(q, "module_label").withColumns({"n_permutations": F.lit(repeats).cast("bigint"), "estimable": enough, "nonestimable_reason": F.when(enough, "").otherwise(f"fewer_than_{minimum_genes}_common_genes")})
    return rows.drop("position", "split_half_seed")


def reliability_table(halves: DataFrame, genes: DataFrame, weights: DataFrame, minimum_genes: int = 3, base: int = 42, positions: DataFrame | None = None) -> DataFrame:
    """One row per module: split-half summary, smallest and median leave-one-out correlation, seed.

    `halves`: module_label, rep, r; `genes`: one cohort's module genes. Only modules with `minimum_genes` have values.
    """
    positions = (module_positions(weights, base) if positions is None else positions).select("module_label", "split_half_seed")
    counts = genes.groupBy("module_label").agg(F.count_distinct("gene").alias("n_common_genes"))
    single = leave_one_out_summary(leave_one_out(genes, minimum_genes)).drop("cohort")
    rows = positions.join(counts, "module_label", "left").join(split_half_summary(halves), "module_label", "left").join(single, "module_label", "left")
    return rows.fillna(0, ["n_common_genes", "split_half_valid_repeats"])


def signed_rank(df: DataFrame, value: str, *keys: str, most_exact: int = 50) -> DataFrame:
    """Wilcoxon signed-rank test per key: n non-zero differences, the rank sum of positive ones, two-sided and greater p.

    Zeros are left out; ties take average ranks. Up to `most_exact` differences (50 at most, while counts are whole
    numbers in a double) p is exact: the sign choices that give each sum of doubled ranks are counted one rank at a time. Beyond, it is normal,
    with the variance reduced by ties.
    """
    if not 0 <= most_exact <= 50:
        raise ValueError("most_exact must lie between 0 and 50")
    some = df.filter(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("_abs", F.abs(value))
    ranked = some.withColumns({"_r": average_rank("_abs", *keys), "_t": F.count(F.lit(1)).over(W.partitionBy(*keys, "_abs")), "_few": F.count(F.lit(1)).over(W.partitionBy(*keys)) <= most_exact})
    t = F.col("_t").cast("double")
    doubled = F.collect_list(F.when(F.col("_few"), (2 * F.col("_r")).cast("int")))
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(t * t - 1).alias("_ties"), F.sort_array(doubled).alias("_d"))
    n, w2 = F.col("n").cast("double"), F.col("w_plus") * 2
    start = F.transform(F.sequence(F.lit(0).cast("int"), (n * (n + 1)).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate("_d", start, lambda c, d: F.transform(c, lambda x, i: x + F.when(i >= d, F.get(c, i - d)).otherwise(0.0)))
    sums = sums.withColumn("_ways", F.when(n <= most_exact, ways))
    add = lambda keep: F.aggregate(F.transform("_ways", lambda x, i: F.when(keep(i), x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n)
    above, below = add(lambda i: i >= w2), add(lambda i: i <= w2)
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))
    tail = normal_tail(z)
    few = n <= most_exact
    return sums.withColumns({"p_two_sided": F.least(F.lit(1.0), 2 * F.when(few, F.least(above, below)).otherwise(tail)), "p_greater": F.when(few, above).otherwise(F.when(z >= 0, tail).otherwise(1 - tail))}).drop("_ties", "_d", "_ways")


def sign_test(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Exact two-sided sign test per key, for up to 1000 non-zero differences (beyond, the normal one)."""
    sums = df.filter(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(value) > 0, 1)).alias("n_positive"))
    n, k = F.col("n"), F.least("n_positive", F.col("n") - F.col("n_positive"))
    first = F.struct(F.exp(-n * F.ln(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        return F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum"))

    exact = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.when(n <= 1000, k)), first, step, lambda a: a["sum"])
    z = F.greatest(F.lit(0.0), F.abs(F.col("n_positive") - n / 2.0) - 0.5) / F.sqrt(n / 4.0)
    return sums.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.when(n <= 1000, exact).otherwise(normal_tail(z))))


def paired_contrasts(bulk: DataFrame, donor: str, cell_type: str, contrasts: list[tuple[str, str]], schedule: DataFrame) -> DataFrame:
    """Per contrast (a, b): donors with both types, signs, mean and median difference, bootstrap interval,
    exact sign-flip p, and q over the contrasts. A contrast without donors has missing p and q.

    `schedule`: rep, pos, idx of bootstrap draws; those with `pos` and `idx` below a contrast's n count.
    """
    from scoreloom.operators.resampling import sign_flip

    spark = bulk.sparkSession
    wanted = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(contrasts)], "contrast int, a string, b string")
    side = bulk.select(F.col(donor).alias("donor"), F.col(cell_type).alias("t"), "mean")
    both = F.broadcast(wanted).join(side.select("donor", F.col("t").alias("a"), F.col("mean").alias("ma")), "a").join(side.select("donor", F.col("t").alias("b"), F.col("mean").alias("mb")), ["donor", "b"])
    diffs = both.select("contrast", "donor", (F.col("ma") - F.col("mb")).alias("difference"))
    placed = diffs.withColumns({"pos": F.row_number().over(W.partitionBy("contrast").orderBy("donor")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("contrast"))})
    drawn = placed.select("contrast", "pos", "n").join(schedule, "pos").withColumn("idx", F.col("idx") % F.col("n")).join(placed.select("contrast", F.col("pos").alias("idx"), "difference"), ["contrast", "idx"])
    means = drawn.groupBy("contrast", "rep").agg(F.avg("difference").alias("m"))
    limits = means.groupBy("contrast").agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
    stats = diffs.groupBy("contrast").agg(F.count(F.lit(1)).alias("n_donors"), F.count(F.when(F.col("difference") > 0, 1)).alias("n_positive"), F.count(F.when(F.col("difference") < 0, 1)).alias("n_negative"), F.avg("difference").alias("mean_difference"), F.median("difference").alias("median_difference"))
    p = sign_flip(diffs, "difference", "contrast").select("contrast", "p_value")
    rows = wanted.join(stats, "contrast", "left").join(limits, "contrast", "left").join(p, "contrast", "left").fillna(0, ["n_donors", "n_positive", "n_negative"])
    return benjamini_hochberg(rows.withColumn("_all", F.lit(1)), "p_value", "_all", order="contrast").drop("_all")


def contrast_tiers(folds: DataFrame, contrasts: list[tuple[str, str]], schedule: DataFrame) -> DataFrame:
    """Models compared in paired folds, per endpoint and module: mean difference of the repeats' means,
    share of positive repeats, bootstrap lower limit, signed-rank p with q per endpoint, and a descriptive tier.

    `folds`: endpoint, module_label, model, repeat, fold, c_index.
    """
    keys = ["endpoint", "module_label"]
    means = folds.groupBy(*keys, "model", "repeat").agg(F.avg("c_index").alias("m"))
    wanted = folds.sparkSession.createDataFrame(contrasts, "model_a string, model_b string")
    pairs = means.join(F.broadcast(wanted), F.col("model") == F.col("model_a")).drop("model").join(means.select(*keys, F.col("model").alias("model_b"), "repeat", F.col("m").alias("mb")), [*keys, "model_b", "repeat"])
    keys = [*keys, "model_a", "model_b"]
    pairs = pairs.select(*keys, "repeat", (F.col("m") - F.col("mb")).alias("delta"))
    placed = pairs.withColumns({"pos": F.row_number().over(W.partitionBy(*keys).orderBy("repeat")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    drawn = placed.select(*keys, "pos", "n").join(schedule, "pos").withColumn("idx", F.col("idx") % F.col("n")).join(placed.select(*keys, F.col("pos").alias("idx"), "delta"), [*keys, "idx"])
    low = drawn.groupBy(*keys, "rep").agg(F.avg("delta").alias("m")).groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("ci_low"))
    rows = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_repeats"), F.avg("delta").alias("mean_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("fraction_positive")).join(low, keys, "left").join(signed_rank(pairs, "delta", *keys).select(*keys, F.col("p_two_sided").alias("p_value")), keys, "left")
    rows = benjamini_hochberg(rows.withColumn("_o", F.concat_ws("/", "module_label", "model_a", "model_b")), "p_value", "endpoint", order="_o").drop("_o")
    return rows.withColumn("support", contrast_tier(F.col("mean_delta"), F.col("fraction_positive"), F.col("ci_low")))
