"""Outcome association: rank statistics, concordance and residuals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import average_rank, normal_tail, student_p, z_score
from scoreloom.sources.shared import written

#: Bands of times and of scores, about; a power of two.
BANDS = 256
#: Distinct rows that a band may have before a key is cut finer.
ROWS = 4096


def roc_auc(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """AUC from average ranks; NULL without both classes."""
    ranked = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*keys, F.col(label).cast("double").alias("_y"), average_rank(score, *keys).alias("_r"))
    n1, n0 = F.sum("_y"), F.sum(1 - F.col("_y"))
    return ranked.groupBy(*keys).agg(n1.cast("bigint").alias("n_positive"), n0.cast("bigint").alias("n_negative"), ((F.sum(F.col("_r") * F.col("_y")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Sum of precision times the gain in recall over distinct thresholds, highest first."""
    steps = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("double")).alias("_tp"))
    down = W.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.withColumns({"_cn": F.sum("_n").over(down), "_ct": F.sum("_tp").over(down)})
    return steps.groupBy(*keys).agg((F.sum(F.col("_tp") * F.col("_ct") / F.col("_cn")) / F.nullif(F.sum("_tp"), F.lit(0.0))).alias("average_precision"))


def concordance(df: DataFrame, time: str, event: str, score: str, *keys: str) -> DataFrame:
    """Harrell's C for a fixed direction: a higher score should mean a shorter time; equal scores count half.

    Pairs are comparable if the shorter time is an event. No pair is made. Times and scores are cut into bands at
    approximate quantiles, each of which is a band of its own, so that a frequent value never swells another's; where the
    cuts lie changes the cost only. Pairs of one band of times are counted in that band, pairs of two bands of times and one of
    scores in the latter, and all others from the number of rows in each two bands. A task holds one band, about
    1 / BANDS of a key's distinct rows, or a key's table of bands.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*keys, F.col(time).alias("_t"), F.col(event).cast("int").alias("_e"), F.col(score).alias("_s")).dropna()
    rows = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_t").cast("double").alias("_t"), F.col("_s").cast("double").alias("_s"), (F.col("_e") == 1).cast("bigint").alias("_e"))
    points = written(rows.groupBy(*names, "_t", "_s").agg(F.count(F.lit(1)).alias("n"), F.sum("_e").alias("e")).withColumn("_all", F.lit(0)), "points")
    names = ["_all", *names]
    cuts = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
    edges = points.groupBy(*names).agg(F.count(F.lit(1)).alias("_m"), *[F.percentile_approx(c, cuts, 10_000).alias(c) for c in ("_t", "_s")])
    # a small key needs few bands
    stride = F.greatest(F.lit(1), F.ceil(F.lit(BANDS * ROWS) / F.col("_m")))
    edges = edges.select(*names, *[F.array_sort(F.array_distinct(F.filter(c, lambda x, i: (i + 1) % stride == 0))).alias(f"{c}_cuts") for c in ("_t", "_s")])
    met = points.join(F.broadcast(edges), names)
    dealt = written(met.select(*names, "_t", "_s", "n", "e", _band("_t").alias("t"), _band("_s").alias("s")), "bands")
    kinds = ", ".join(f"{k} {t}" for k, t in dealt.dtypes if k in names)
    shape = f"{kinds}, pairs bigint, won bigint"

    def counted(count):
        def work(group: pa.Table) -> pa.Table:
            pairs, won = count(*(group.column(c).to_numpy() for c in ("x", "y", "n", "e")))
            return pa.table({k: group.column(k)[:1].combine_chunks() for k in names} | {"pairs": pa.array([pairs], pa.int64()), "won": pa.array([won], pa.int64())})

        return work

    # bands of one time have no pairs within
    near = dealt.filter(F.col("t") % 2 == 0).select(*names, F.col("t").alias("band"), F.col("_t").alias("x"), F.col("_s").alias("y"), "n", "e")
    level = dealt.groupBy(*names, F.col("s").alias("band"), F.col("t").alias("x"), F.col("_s").alias("y")).agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    far = dealt.groupBy(*names, F.col("t").alias("x"), F.col("s").alias("y")).agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    parts = near.groupBy(*names, "band").applyInArrow(counted(dominated), shape)
    # pairs of these two are among those of `far`, which can't tell scores of one band apart
    parts = parts.unionByName(level.groupBy(*names, "band").applyInArrow(counted(lambda x, y, n, e: (0, dominated(x, y, n, e)[1])), shape))
    parts = parts.unionByName(far.groupBy(*names).applyInArrow(counted(lambda x, y, n, e: dominated(x, y, n, e, ties=False)), shape))
    some = points.groupBy(*names).agg(F.sum("e").alias("e")).filter("e > 0").select(*names)
    sums = parts.join(F.broadcast(some), names, "left_semi").groupBy(*names[1:]).agg(F.sum("pairs").alias("n_pairs"), F.sum("won").alias("_won"))
    return sums.select(*[F.col(n).alias(k) for k, n in zip(keys, names[1:], strict=True)], "n_pairs", (F.col("_won") / 2.0 / F.nullif(F.col("n_pairs"), F.lit(0))).alias("c_index"))


def _band(value: str) -> Column:
    """Twice the number of cuts below the value, one more where it is a cut."""
    cuts = F.col(f"{value}_cuts")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(BANDS.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < F.col(value), step).otherwise(0))
    return 2 * below + F.coalesce(F.get(cuts, below) == F.col(value), F.lit(False)).cast("int")


def dominated(x: np.ndarray, y: np.ndarray, n: np.ndarray, e: np.ndarray, ties: bool = True) -> tuple[int, int]:
    """Pairs of an event and a row with a larger x, and twice those with a smaller y too; equal y count once, with `ties`.

    Ranks of y differ first at one binary digit: per digit and common prefix, running sums over x.
    """
    _, r = np.unique(y, return_inverse=True)
    down = np.lexsort((-x,))
    x, r, n, e = x[down], r[down], n[down], e[down]

    def later(prefix: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of the prefix, and for each the weights of the same prefix with a larger x."""
        at = np.argsort(prefix, kind="stable")
        p, w = prefix[at], weight[at]
        upto = np.cumsum(w) - w
        new = np.concatenate(([True], p[1:] != p[:-1]))
        run = new | np.concatenate(([True], x[at][1:] != x[at][:-1]))
        place = np.arange(len(at))
        first, own = np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(run, place, 0))
        return at, upto[own] - upto[first]

    at, ahead = later(np.zeros(len(r), np.int64), n)
    pairs, won = int((e[at] * ahead).sum()), 0
    for d in range(int(r.max()).bit_length() if len(r) else 0):
        bit = (r >> d) & 1
        at, ahead = later(r >> (d + 1), n * (1 - bit))
        won += 2 * int((e[at] * bit[at] * ahead).sum())
    if ties:
        at, ahead = later(r, n)
        won += int((e[at] * ahead).sum())
    return pairs, won


def mann_whitney(df: DataFrame, value: str, group: str, *keys: str) -> DataFrame:
    """U of the true group and its two-sided p by the normal approximation with ties and continuity."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = rows.select(*keys, F.col(group).cast("double").alias("_g"), average_rank(value, *keys).alias("_r"), F.count(F.lit(1)).over(W.partitionBy(*keys, value)).cast("double").alias("_k"))
    sums = ranked.groupBy(*keys).agg(F.sum("_g").alias("n1"), F.sum(1 - F.col("_g")).alias("n2"), F.sum(F.col("_r") * F.col("_g")).alias("_w"), F.sum(F.col("_k") * F.col("_k") - 1).alias("_ties"))
    n, u = F.col("n1") + F.col("n2"), F.col("_w") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5) / F.nullif(sd, F.lit(0.0))
    return sums.select(*keys, u.alias("u"), F.least(F.lit(1.0), 2 * normal_tail(z)).alias("p_value"))


def residual(df: DataFrame, y: str, x: str, *keys: str, name: str = "residual", least_rows: int = 10) -> DataFrame:
    """z-scored residual of y on x within keys; NULL for fewer rows or a constant covariate."""
    part = W.partitionBy(*keys)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    slope = F.covar_samp(xs, ys).over(part) / F.nullif(F.var_samp(xs).over(part), F.lit(0.0))
    raw = ys - (F.avg(ys).over(part) + slope * (xs - F.avg(xs).over(part)))
    df = df.withColumn("_r", F.when(F.count(xs).over(part) >= least_rows, raw))
    return df.withColumn(name, z_score(F.col("_r"), part)).drop("_r")


def fold_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, median, minimum and maximum over folds; NULL keys keep their group."""
    return df.groupBy(*keys).agg(F.count(value).alias("n_folds"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def corrected_t(df: DataFrame, difference: str, folds: int, *keys: str) -> DataFrame:
    """t statistic of repeated k-fold differences with variance (1/n + 1/(k - 1)) s^2, and its two-sided p."""
    n, s2 = F.count(difference), F.var_samp(difference)
    se = F.sqrt((1 / n + F.lit(1.0 / (folds - 1))) * s2)
    found = df.groupBy(*keys).agg(n.alias("n"), F.avg(difference).alias("mean_difference"), (F.avg(difference) / F.nullif(se, F.lit(0.0))).alias("t"))
    return found.withColumn("p_value", F.when(F.col("t").isNotNull() & (F.col("n") > 1), student_p(F.col("t"), F.col("n") - 1.0)))


def contrast_tier(mean: Column, positive: Column, low: Column) -> Column:
    """Ordered descriptive tiers of a model contrast."""
    return F.when((mean >= 0.02) & (positive >= 0.75) & (low > 0), "strong_descriptive_support").when((mean >= 0.01) & (positive >= 0.6), "moderate_descriptive_support").when(mean > 0, "weak_positive_descriptive_support").otherwise("no_consistent_positive_support")
