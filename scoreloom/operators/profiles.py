"""Nearest profiles between two cohorts, to tell whether they share samples.

Samples are dealt to tiles; a task has one tile of each cohort, multiplies their standardised profiles a few rows at a time
and keeps the best of each sample. No table of pairs is made. What is sent grows with the samples up to SHARE * LARGE of a
cohort, beyond that with their square over LARGE; all pairs are multiplied, so time grows with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import average_rank
from scoreloom.sources.shared import written

#: Samples to a tile, at least and at most: a cohort has SHARE tiles between these bounds, so that each profile is sent to SHARE tasks.
TILE, LARGE, SHARE = 2048, 32768, 8
#: Correlations that a task holds at once, of each kind.
CELLS = 1 << 22
#: Correlations are compared to so many digits, so that rounding doesn't choose among equals.
DIGITS = 10


def profiles(expr: DataFrame) -> DataFrame:
    """(cohort, sample_id, ranks, centred): a sample's values over genes in order, as average ranks and less the gene's mean in its cohort.

    A sample that lacks genes which others have, or their values, raises: impute or leave out first.
    """
    means = expr.groupBy("cohort", "gene").agg(F.avg("value").alias("_m"))
    rows = expr.select("cohort", "sample_id", "gene", "value").join(means, ["cohort", "gene"]).select("cohort", "sample_id", "gene", "value", (F.col("value") - F.col("_m")).alias("c"), average_rank("value", "cohort", "sample_id").alias("k"))
    whole = rows.groupBy("cohort", "sample_id").agg(F.sort_array(F.collect_list(F.struct("gene", "k", "c"))).alias("v"), F.count("value").alias("n"))
    genes = expr.agg(F.count_distinct("gene")).first()[0]
    ok = (F.size("v") == genes) & (F.col("n") == genes)
    checked = F.when(ok, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("incomplete profile: "), F.col("sample_id"))))
    return whole.select("cohort", "sample_id", checked.alias("v")).select("cohort", "sample_id", F.col("v.k").alias("ranks"), F.col("v.c").alias("centred"))


def _unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows centred and of length 1, and which are not constant."""
    x = column.combine_chunks().flatten().to_numpy().astype(float).reshape(len(column), -1)
    flat = x.max(axis=1) == x.min(axis=1)
    x -= x.mean(axis=1, keepdims=True)
    length = np.sqrt((x * x).sum(axis=1))
    flat |= length == 0
    return x / np.where(flat, 1, length)[:, None], ~flat


def profile_neighbours(expr: DataFrame, reference: str, external: str, rank_hard: float = 0.995, centred_hard: float = 0.98, rank_joint: float = 0.985, centred_joint: float = 0.90) -> DataFrame:
    """Nearest reference profile of every external sample, by correlation of ranks and of gene-centred values.

    `expr`: cohort, sample_id, gene, value. One row per external sample: sample, the largest of both correlations with the
    sample it belongs to (of equals the first), and whether some pair reaches a hard limit or both joint ones. A constant profile
    has no correlation.
    """
    made = written(profiles(expr.filter(F.col("cohort").isin(reference, external))), "profiles")
    sizes = {r["cohort"]: r["n"] for r in made.groupBy("cohort").agg(F.count(F.lit(1)).alias("n")).collect()}
    tile = min(LARGE, max(TILE, -(-max(sizes.values(), default=1) // SHARE)))
    ta, tb = (-(-sizes.get(c, 1) // tile) for c in (external, reference))

    def dealt(cohort: str, mine: str, tiles: int, other: str, others: int) -> DataFrame:
        own = F.pmod(F.xxhash64("sample_id"), F.lit(tiles)).cast("int").alias(mine)
        return made.filter(F.col("cohort") == cohort).select(own, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), F.col("sample_id").alias("sample_id"), F.col("ranks").cast("array<float>").alias("ranks"), F.col("centred").alias("centred"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("sample_id"), right.sort_by("sample_id")
        names = np.array(right.column("sample_id").to_pylist(), dtype=object)
        out: dict[str, list] = {"sample": left.column("sample_id").to_pylist()}
        if not len(left) or not len(right):
            return pa.table({k: pa.array(out["sample"] if k == "sample" else [None] * len(left), t) for k, t in TYPES.items()})
        units = {k: (_unit(left.column(k)), _unit(right.column(k))) for k in ("ranks", "centred")}
        out |= {k: [] for k in TYPES if k != "sample"}
        step = max(1, CELLS // len(right))
        for rows in (slice(i, i + step) for i in range(0, len(left), step)):
            found = {}
            for k, ((a, fa), (b, fb)) in units.items():
                r = np.round(np.clip(a[rows] @ b.T, -1, 1), DIGITS)
                r[~fa[rows]], r[:, ~fb] = -2, -2  # below any correlation
                found[k] = r
                at = r.argmax(axis=1)
                best = r[np.arange(len(r)), at]
                out[k] += [float(x) if x >= -1 else None for x in best]
                out[f"{k}_of"] += [n if x >= -1 else None for n, x in zip(names[at].tolist(), best, strict=True)]
            r, c = found["ranks"], found["centred"]
            out["suspect"] += ((r >= rank_hard) | (c >= centred_hard) | ((r >= rank_joint) & (c >= centred_joint))).any(axis=1).tolist()
        return pa.table({k: pa.array(out[k], t) for k, t in TYPES.items()})

    best = dealt(external, "ta", ta, "tb", tb).groupBy("ta", "tb").cogroup(dealt(reference, "tb", tb, "ta", ta).groupBy("ta", "tb")).applyInArrow(work, "sample string, ranks double, ranks_of string, centred double, centred_of string, suspect boolean")
    by = W.partitionBy("sample")
    top = {k: F.first(f"{k}_of").over(by.orderBy(F.desc_nulls_last(k), f"{k}_of")) for k in ("ranks", "centred")}
    rows = best.withColumns({f"{k}_top": v for k, v in top.items()})
    return rows.groupBy("sample").agg(F.max("ranks").alias("maximum_rank_r"), F.max("ranks_top").alias("nearest_by_rank"), F.max("centred").alias("maximum_centred_r"), F.max("centred_top").alias("nearest_by_centred"), F.coalesce(F.max("suspect"), F.lit(False)).alias("suspect"))


TYPES = {"sample": pa.string(), "ranks": pa.float64(), "ranks_of": pa.string(), "centred": pa.float64(), "centred_of": pa.string(), "suspect": pa.bool_()}
