"""Regression of outcomes on a score: Cox and logistic models, many at once, by Newton steps over DataFrames.

Rows stay where they are; a step sums gradient and Hessian of each model by partial aggregation, and the driver
solves a system of a few unknowns per model. So a model may have any number of rows; up to MOST_MODELS models
(of a dozen covariates) are fitted side by side, and their coefficients are all that is sent around.

Cox: sums over risk sets are a scan over time in two levels. Times are cut into ranges at approximate quantiles
(rows of one time share a range); running sums are taken within ranges, the ranges' totals are
carried on. Ties by Efron's rule. The test of proportional hazards correlates scaled Schoenfeld residuals
with the events' ranks in time; rows of one time share a rank, so sums per time are all it needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import finite
from scoreloom.sources.shared import written

MOST_MODELS = 100_000
#: Rows of a model for which one more range of times is made, up to MOST_RANGES.
RANGE_ROWS = 20_000
MOST_RANGES = 256
Z95 = 1.959963984540054


def upper(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def newton(evaluate: Callable[[dict[str, np.ndarray]], dict], names: list[str], size: int, penalty: float, steps: int = 100) -> dict[str, dict]:
    """Coefficients of all models: {name: b, cov, extra, reason}; a step that lowers the likelihood is halved.

    `evaluate` gives for each name (log likelihood, gradient, information matrix, further sums).
    """
    state = {n: {"b": np.zeros(size), "step": np.zeros(size), "ll": -np.inf} for n in names}
    done: dict[str, dict] = {}
    for _ in range(steps):
        if not state:
            break
        found = evaluate({n: s["b"] for n, s in state.items()})
        for n in list(state):
            s = state[n]
            if n not in found:
                done[n] = {"reason": "no_events"}
                del state[n]
                continue
            ll, g, h, extra = found[n]
            ll -= penalty / 2 * float(s["b"] @ s["b"])
            g, h = g - penalty * s["b"], h + penalty * np.eye(size)
            if not np.isfinite(ll) or ll < s["ll"] - 1e-10 * (1 + abs(ll)):
                s["step"] = s["step"] / 2
                s["b"] = s["b"] - s["step"]
                if np.abs(s["step"]).max() < 1e-12:
                    done[n] = {"reason": "not_converged"}
                    del state[n]
                continue
            try:
                cov = np.linalg.inv(h)
                step = cov @ g
            except np.linalg.LinAlgError:
                step = np.full(size, np.nan)
            if not np.isfinite(step).all():
                done[n] = {"reason": "singular"}
                del state[n]
            elif np.abs(step).max() < 1e-11:
                done[n] = {"b": s["b"] + step, "cov": cov, "extra": extra, "reason": ""}
                del state[n]
            else:
                s.update(ll=ll, step=step, b=s["b"] + step)
    return done | {n: {"reason": "not_converged"} for n in state}


def prepared(df: DataFrame, needed: dict[str, str], score: str, covariates: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Complete rows (_m, the needed columns, x0..xk) with the score standardised, and the models (_m, keys, sd).

    The score is standardised over all its finite values of the model, before incomplete rows go.
    """
    names = {f"x{i + 1}": c for i, c in enumerate(covariates)}
    rows = df.select(
        F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k")])).alias("_m"), *keys,
        *[finite(F.col(c).cast("double")).alias(n) for n, c in needed.items()], finite(F.col(score).cast("double")).alias("s"), *[finite(F.col(c).cast("double")).alias(n) for n, c in names.items()],
    )
    x = F.col("s")
    models = written(rows.groupBy("_m", *keys).agg(F.avg(x).alias("_mean"), F.when(F.max(x) > F.min(x), F.stddev_samp(x)).alias("_sd")), "models")
    if models.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    joined = rows.drop(*keys).join(F.broadcast(models.select("_m", "_mean", "_sd")), "_m")
    # a constant score has no standardised values, yet its rows count
    done = joined.filter("s is not null").withColumn("x0", F.coalesce((x - F.col("_mean")) / F.col("_sd"), F.lit(0.0))).drop("s", "_mean", "_sd")
    return done.dropna(), models


def with_b(rows: DataFrame, betas: dict[str, np.ndarray], more: dict[str, float] | None = None) -> DataFrame:
    """Rows of the models asked for, with their coefficients b and linear predictor eta."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(m, b.tolist(), (more or {}).get(m, 0.0)) for m, b in betas.items()], "_m string, b array<double>, known double")
    return rows.join(F.broadcast(table), "_m")


def table_of(fits: dict[str, dict], models: DataFrame, counts: DataFrame, reasons: Column, ratio: str, more: Callable[[dict], float | None] | None = None) -> DataFrame:
    """One row per model with the score's coefficient, ratio, interval and p."""
    rows = []
    for m, f in fits.items():
        if f["reason"]:
            rows.append((m, None, None, None, None, None, None, f["reason"]))
            continue
        at = f.get("at", 0)
        b, se = float(f["b"][at]), math.sqrt(f["cov"][at, at])
        rows.append((m, b, math.exp(b), math.exp(b - Z95 * se), math.exp(b + Z95 * se), math.erfc(abs(b) / se / math.sqrt(2)), more(f) if more else None, ""))
    spark = models.sparkSession
    fitted = spark.createDataFrame(rows, f"_m string, coef double, {ratio} double, ci_low double, ci_high double, p_value double, ph_p double, why string")
    out = models.drop("_mean", "_sd").join(counts, "_m", "left").join(F.broadcast(fitted), "_m", "left")
    out = out.withColumn("reason", F.coalesce(reasons, F.col("why"), F.lit(""))).drop("_m", "why")
    return out if more else out.drop("ph_p")


def cox(df: DataFrame, time: str, event: str, score: str, *keys: str, covariates: tuple[str, ...] = (), penalty: float = 0.0, least_rows: int = 20, least_events: int = 5) -> DataFrame:
    """Hazard ratio per SD of the score, one model per key: n, events, coef, hazard_ratio, ci_low, ci_high, p_value, ph_p, reason.

    The score is standardised over a model's rows; rows that lack a value (or have an infinite one) go. Models
    with fewer rows or events than needed, or a constant score, aren't fitted and name the reason.
    """
    size = 1 + len(covariates)
    xs = [f"x{i}" for i in range(size)]
    rows, models = prepared(df, {"t": time, "e": event}, score, list(covariates), list(keys))
    cuts = rows.groupBy("_m").agg(F.count(F.lit(1)).alias("n"), F.sum("e").cast("bigint").alias("events"), F.percentile_approx("t", F.array(*[F.lit(i / MOST_RANGES) for i in range(1, MOST_RANGES)]), F.lit(10 * MOST_RANGES)).alias("cuts"))
    counts = written(cuts.join(F.broadcast(models.select("_m", "_sd")), "_m"), "counts")
    # fewer ranges for fewer rows
    step = F.greatest(F.lit(1), F.floor(MOST_RANGES / F.greatest(F.lit(1.0), F.col("n") / RANGE_ROWS)).cast("int"))
    edges = counts.select("_m", F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % step == 0)).alias("edges"))
    placed = rows.join(F.broadcast(edges), "_m").withColumn("part", F.size(F.filter("edges", lambda c: c < F.col("t")))).drop("edges")
    placed = written(placed, "rows")
    reasons = F.when(F.coalesce("n", F.lit(0)) < least_rows, "too_few_rows").when(F.col("events") < least_events, "too_few_events").when(F.col("constant"), "constant_score")
    ready = counts.withColumns({"constant": F.col("_sd").isNull()}).drop("cuts", "_sd")
    total = {r["_m"]: float(r["events"]) for r in ready.filter(reasons.isNull()).select("_m", "events").collect()}
    pairs = upper(size)

    def evaluate(betas: dict[str, np.ndarray]) -> dict:
        r = with_b(placed, betas, total)
        eta = sum((F.col("b")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
        w = F.exp(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), eta)))
        e, r = F.col("e"), r.withColumns({"w": w, "eta": eta})
        risk = {"S": F.col("w")} | {f"S{i}": F.col("w") * F.col(x) for i, x in enumerate(xs)} | {f"S{i}_{j}": F.col("w") * F.col(xs[i]) * F.col(xs[j]) for i, j in pairs}
        dead = {"Q" + k[1:]: e * c for k, c in risk.items()}
        sums = [F.sum(c).alias(k) for k, c in (risk | dead).items()] + [F.sum(e).alias("d"), F.sum(e * F.col("eta")).alias("eta")] + [F.sum(e * F.col(x)).alias(f"E{i}") for i, x in enumerate(xs)]
        at = r.groupBy("_m", "known", "part", "t").agg(*sums)
        # the scan: within ranges of time, and over them
        run = W.partitionBy("_m", "part").orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, W.currentRow)
        later = W.partitionBy("_m").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
        carried = ["d", *risk]
        totals = at.groupBy("_m", "part").agg(*[F.sum(c).alias(c) for c in carried])
        prefix = totals.select("_m", "part", *[F.coalesce(F.sum(c).over(later), F.lit(0.0)).alias(f"p_{c}") for c in carried])
        scanned = at.withColumns({f"r_{c}": F.sum(c).over(run) for c in carried}).join(prefix, ["_m", "part"])
        scanned = scanned.filter("d > 0").withColumns({f"r_{c}": F.col(f"r_{c}") + F.col(f"p_{c}") for c in carried})

        def term(a: Column, k: Column) -> Column:
            """One of the d tied events: the risk set without k / d of them."""
            f = k / F.col("d")
            left = {c: F.col(f"r_{c}") - f * F.col("Q" + c[1:]) for c in risk}
            mean = [left[f"S{i}"] / left["S"] for i in range(size)]
            parts = [(a["ll"] + F.ln(left["S"])).alias("ll")] + [(a[f"m{i}"] + mean[i]).alias(f"m{i}") for i in range(size)]
            return F.struct(*parts, *[(a[f"h{i}_{j}"] + left[f"S{i}_{j}"] / left["S"] - mean[i] * mean[j]).alias(f"h{i}_{j}") for i, j in pairs])

        zero = F.struct(*[F.lit(0.0).alias(c) for c in ["ll", *[f"m{i}" for i in range(size)], *[f"h{i}_{j}" for i, j in pairs]]])
        tied = scanned.withColumn("a", F.aggregate(F.sequence(F.lit(0), F.col("d").cast("int") - 1), zero, term))
        # rank of a time's events, less the mean rank
        rank = F.col("known") - F.col("r_d") + (F.col("d") + 1) / 2 - (F.col("known") + 1) / 2
        gradient = [F.col(f"E{i}") - F.col(f"a.m{i}") for i in range(size)]
        out = tied.groupBy("_m").agg(
            F.sum(F.col("eta") - F.col("a.ll")).alias("ll"), F.sum(F.col("d") * rank * rank).alias("spread"),
            *[F.sum(g).alias(f"g{i}") for i, g in enumerate(gradient)], *[F.sum(g * rank).alias(f"u{i}") for i, g in enumerate(gradient)], *[F.sum(f"a.h{i}_{j}").alias(f"h{i}_{j}") for i, j in pairs],
        )
        return {r["_m"]: (r["ll"], np.array([r[f"g{i}"] for i in range(size)]), matrix(r, size), (r["spread"], np.array([r[f"u{i}"] for i in range(size)]), total[r["_m"]])) for r in out.collect()}

    def ph(f: dict) -> float | None:
        spread, u, n = f["extra"]
        v = f["cov"]
        return math.erfc(math.sqrt(n * float((v @ u)[0]) ** 2 / (v[0, 0] * spread) / 2)) if spread > 0 else None

    fits = newton(evaluate, list(total), size, penalty)
    out = table_of(fits, models, ready, reasons, "hazard_ratio", ph)
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("events", F.lit(0)).alias("events"), "coef", "hazard_ratio", "ci_low", "ci_high", "p_value", "ph_p", "reason")


def matrix(row, size: int) -> np.ndarray:
    h = np.zeros((size, size))
    for i, j in upper(size):
        h[i, j] = h[j, i] = row[f"h{i}_{j}"]
    return h


def logistic(df: DataFrame, label: str, score: str, *keys: str, covariates: tuple[str, ...] = (), penalty: float = 0.0, least_rows: int = 20, least_class: int = 5) -> DataFrame:
    """Odds ratio per SD of the score, one model per key: n, positives, negatives, coef, odds_ratio, ci_low, ci_high, p_value, reason.

    Labels other than 0 and 1 go, as rows that lack a value. Iteratively reweighted least squares: sums over all rows per step.
    """
    size = 2 + len(covariates)
    rows, models = prepared(df, {"y": label}, score, list(covariates), list(keys))
    rows = written(rows.filter("y in (0, 1)"), "rows")
    counts = written(rows.groupBy("_m").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives")).join(F.broadcast(models.select("_m", "_sd")), "_m"), "counts")
    fewest = F.least(F.col("positives"), F.col("n") - F.col("positives"))
    reasons = F.when(F.coalesce("n", F.lit(0)) < least_rows, "too_few_rows").when(fewest < least_class, "too_few_of_a_class").when(F.col("constant"), "constant_score")
    ready = counts.withColumn("constant", F.col("_sd").isNull()).drop("_sd")
    names = [r["_m"] for r in ready.filter(reasons.isNull()).select("_m").collect()]
    # the score first, the constant last
    xs = [F.col(f"x{i}") for i in range(size - 1)] + [F.lit(1.0)]

    def evaluate(betas: dict[str, np.ndarray]) -> dict:
        r = with_b(rows, betas)
        eta = sum((F.col("b")[i] * x for i, x in enumerate(xs)), F.lit(0.0))
        r = r.withColumn("eta", eta).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        # ln(1 + exp(eta)) without overflow
        soft = F.greatest(F.lit(0.0), F.col("eta")) + F.log1p(F.exp(-F.abs("eta")))
        out = r.groupBy("_m").agg(
            F.sum(F.col("y") * F.col("eta") - soft).alias("ll"), *[F.sum((F.col("y") - F.col("p")) * x).alias(f"g{i}") for i, x in enumerate(xs)],
            *[F.sum(F.col("p") * (1 - F.col("p")) * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in upper(size)],
        )
        return {r["_m"]: (r["ll"], np.array([r[f"g{i}"] for i in range(size)]), matrix(r, size), None) for r in out.collect()}

    fits = newton(evaluate, names, size, penalty)
    out = table_of(fits, models, ready, reasons, "odds_ratio")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce(F.col("n") - F.col("positives"), F.lit(0)).alias("negatives"), "coef", "odds_ratio", "ci_low", "ci_high", "p_value", "reason")
