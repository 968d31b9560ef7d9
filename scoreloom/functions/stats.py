"""Statistics as column expressions; all are safe under ANSI mode and treat NULL as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over the rows where both are there; NULL if one is constant."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    ok = a.isNotNull() & b.isNotNull()
    a, b = F.when(ok, a), F.when(ok, b)
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 within the keys; ties get the mean of their ranks."""
    part = W.partitionBy(*keys)
    return F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def percent_rank_average(value: str, *keys: str) -> Column:
    """Average rank divided by the number of rows."""
    return average_rank(value, *keys) / F.count(value).over(W.partitionBy(*keys))


def spearman(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Spearman correlation of two columns within keys: one row per key, column `spearman`."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.select(*keys, average_rank(a, *keys).alias("_ra"), average_rank(b, *keys).alias("_rb"))
    return ranked.groupBy(*keys).agg(safe_corr("_ra", "_rb").alias("spearman"))


def z_score(x: Column, over: WindowSpec) -> Column:
    """(x - mean) / sd with n - 1; NULL where the window is constant (its maximum is its minimum)."""
    sd = F.when(F.max(x).over(over) > F.min(x).over(over), F.stddev_samp(x).over(over))
    return (x - F.avg(x).over(over)) / sd


def benjamini_hochberg(df: DataFrame, p: str, *family: str, order: str, q: str = "q_value", size: str | None = None) -> DataFrame:
    """Adds q values within each family.

    NULL, NaN and infinite p are not members and get NULL; a finite p outside [0, 1] raises. The family
    is the unit of a window: correct families apart, never a whole corpus as one.
    """
    ok = finite(F.col(p))
    bad = ok.isNotNull() & ((ok < 0) | (ok > 1))
    df = df.withColumn("_p", F.when(bad, F.raise_error(F.concat(F.lit("p outside [0, 1]: "), ok.cast("string"))).cast("double")).otherwise(ok))
    part = W.partitionBy(*family)
    up = part.orderBy(F.col("_p").asc_nulls_last(), F.col(order))
    df = df.withColumns({"_m": F.count("_p").over(part), "_k": F.row_number().over(up)})
    raw = F.col("_p") * F.col("_m") / F.col("_k")
    # from the largest p down, as a frame that only grows is one pass; one that ends at the last row starts anew at every row
    down = part.orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn(q, F.when(F.col("_p").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min(raw).over(down)))))
    if size:
        df = df.withColumn(size, F.col("_m"))
    return df.drop("_p", "_m", "_k")


def significant(q: str | Column, alpha: float) -> Column:
    """q < alpha, strictly; missing q is not significant."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    return F.coalesce((F.col(q) if isinstance(q, str) else q) < alpha, F.lit(False))


def empirical_p(count: Column, n: Column | int) -> Column:
    """(count + 1) / (n + 1); raises unless 0 <= count <= n and n >= 1."""
    n = F.lit(n) if isinstance(n, int) else n
    bad = (n < 1) | (count < 0) | (count > n)
    return F.when(bad, F.raise_error(F.lit("count must lie between 0 and n, n at least 1")).cast("double")).otherwise((count + 1) / (n + 1.0))


def exact_median(df: DataFrame, value: str, *keys: str, name: str = "median") -> DataFrame:
    """The exact median of each key: keys, `name`.

    Approximate quantiles give each key a narrow interval around it (0.004 of its rows; the approximation's error is a
    twentieth of that); only distinct values inside are counted and ordered. A key's interval is one row, sent to every task.
    """
    rows = df.select(*keys, F.col(value).alias("_x")).filter(F.col(value).isNotNull())
    near = F.percentile_approx("_x", F.array(F.lit(0.498), F.lit(0.502)), 10_000)
    around = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), near.alias("_q")).select(*keys, "_n", F.col("_q")[0].alias("_a"), F.col("_q")[1].alias("_b"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    met = rows.alias("r").join(F.broadcast(around.alias("a")), on) if keys else rows.alias("r").crossJoin(F.broadcast(around.alias("a")))
    met = met.filter("_x <= _b").select(*[F.col(f"a.{k}").alias(k) for k in keys], "_n", F.when(F.col("_x") >= F.col("_a"), F.col("_x")).alias("_x"))
    # the row without a value counts all below the interval; it comes first
    counts = met.groupBy(*keys, "_n", "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    placed = counts.withColumn("_u", upto).filter((F.col("_u") >= low) & F.col("_x").isNotNull())
    found = placed.groupBy(*keys).agg(F.min("_x").alias("_l"), F.min(F.when(F.col("_u") >= high, F.col("_x"))).alias("_h"))
    return found.select(*keys, ((F.col("_l") + F.col("_h")) / 2.0).alias(name))


def quantile_bins(df: DataFrame, value: str, bins: int, *keys: str, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins from 0, lowest value included, equal edges merged."""
    cuts = F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)])))
    edges = df.groupBy(*keys).agg(cuts.alias("_edges"))
    joined = df.join(edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    inner = F.slice("_edges", 2, F.greatest(F.lit(0), F.size("_edges") - 2))
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))))).drop("_edges")


def floor_bins(share: Column, bins: int) -> Column:
    """min(floor(share * bins), bins - 1) for shares from 0 to 1."""
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal for 0 < p < 1, by rational approximation (error below 2e-9)."""
    # Coefficients of the published rational approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(k: tuple, x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + F.lit(v)
        return out

    mid, r = p - 0.5, (p - 0.5) * (p - 0.5)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < 0.02425, poly(c, low) / poly(d, low)).when(p > 1 - 0.02425, -poly(c, high) / poly(d, high)).otherwise(poly(a, r) * mid / poly(b, r))


def rank_gaussian(df: DataFrame, value: str, *keys: str, name: str = "gaussian", eps: float = 1e-6) -> DataFrame:
    """Normal quantile of (average rank - 0.5) / n; missing counts as the median, constant gives 0."""
    part = W.partitionBy(*keys)
    df = df.withColumn("_v", F.coalesce(F.col(value), F.median(value).over(part)))
    share = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), (average_rank("_v", *keys) - 0.5) / F.count(F.lit(1)).over(part)))
    return df.withColumn(name, F.when(F.max("_v").over(part) > F.min("_v").over(part), inverse_normal(share)).otherwise(0.0)).drop("_v")


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal at |z| (error below 1e-7), by a published polynomial."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) * 0.3989422804014327 * poly


def student_p(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided p of Student's t with df degrees of freedom.

    With t = sqrt(df) tan(a) the density is cos(a)^(df - 1) up to a constant, so p is the quotient of two
    integrals by Simpson's rule; no gamma function is needed.
    """
    half = 3.141592653589793 / 2

    def integral(low: Column) -> Column:
        h = (F.lit(half) - low) / steps

        def term(i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return weight * F.pow(F.greatest(F.lit(0.0), F.cos(low + i * h)), df - 1)

        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + term(i)) * h / 3

    return F.least(F.lit(1.0), integral(F.atan(F.abs(t) / F.sqrt(df))) / integral(F.lit(0.0)))
