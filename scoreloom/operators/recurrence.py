"""Blind rediscovery: correlation modules found anew, and how they match frozen ones.

Samples are only ever met in blocks: ranks are made of blocks of a gene's values, correlations of blocks of samples. Parts
of a cohort (repeats of subsamples) go together as lists of ranks, so rows are not copied for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.operators.moments import TILE, _coded
from scoreloom.sources.shared import written

#: Values of a gene to a block, about, and ranks (samples x genes x parts) to a block of samples: some 100 MB a task.
VALUES = 16_384
CELLS = 2_000_000


def rank_columns(x: np.ndarray) -> np.ndarray:
    """Average ranks of each column."""
    out = np.empty(x.shape)
    for k in range(x.shape[1]):
        _, inverse, counts = np.unique(x[:, k], return_inverse=True, return_counts=True)
        ends = np.cumsum(counts)
        out[:, k] = (ends - (counts - 1) / 2)[inverse]
    return out


def spearman_matrix(x: np.ndarray) -> np.ndarray:
    """Spearman correlations of the columns, clipped to [-1, 1], with ones on the diagonal."""
    r = rank_columns(x)
    sd = r.std(axis=0)
    z = (r - r.mean(axis=0)) / np.where(sd > 0, sd, 1)
    c = np.clip(z.T @ z / len(x), -1, 1)
    np.fill_diagonal(c, 1)
    return c


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Labels of average-linkage clusters joined up to a distance of `cut`: each cluster's smallest place.

    Chains of nearest neighbours: clusters that are each other's nearest are joined at once, as no later join
    brings them closer to others; time goes with the square of the number. A cluster without a neighbour
    within the cut is finished.
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    members = [[i] for i in range(n)]
    for start in range(n):
        chain = [start] if label[start] == start and d[start].min() <= cut else []
        while chain:
            x = chain[-1]
            y = int(np.argmin(d[x]))
            if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
                y = chain[-2]
            if d[x, y] > cut:
                d[x], d[:, x] = np.inf, np.inf
                chain.pop()
            elif len(chain) > 1 and y == chain[-2]:
                i, j = min(x, y), max(x, y)
                merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
                d[j], d[:, j] = np.inf, np.inf
                merged[[i, j]] = np.inf
                d[i], d[:, i] = merged, merged
                size[i] += size[j]
                members[i] += members[j]
                label[members[j]] = i
                del chain[-2:]
                chain = chain or [i]
            else:
                chain.append(y)
    return label


def gene_modules(z: DataFrame, cut_correlation: float, least_genes: int = 5) -> DataFrame:
    """(cohort, gene, module_id): clusters of genes by 1 - Spearman; 0 for genes of small clusters.

    A cohort's genes x genes matrix is one task's work, as the method needs it; choose the most variable
    genes first (thousands), never all of a corpus. Its samples may be as many as they like.
    """
    return part_modules(z, [F.lit(True)], cut_correlation, least_genes).select("cohort", "gene", "module_id")


def part_modules(z: DataFrame, inside: list[Column], cut_correlation: float, least_genes: int = 5) -> DataFrame:
    """(cohort, part, gene, module_id): `gene_modules` in parts of each cohort's samples; `inside` says of each part whether a sample is in it.

    A value that is missing, or whose row is, ranks behind all others.
    """
    parts = len(inside)
    value = F.col("z").cast("double")
    rows = written(z.select("cohort", "sample_id", "gene", F.when(~F.isnan(value), value).alias("z"), F.array(*inside).alias("inside")), "parts")
    samples = rows.groupBy("cohort", "sample_id").agg(F.first("inside").alias("inside"))
    totals = written(samples.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), _sums("inside", parts).alias("total")), "totals")
    most = totals.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    genes = max(1, rows.agg(F.approx_count_distinct("gene").alias("n")).first()["n"])
    dealt, facts = value_blocks(rows, parts, -(-most // VALUES))
    facts = written(facts.join(totals.select("cohort", "total"), "cohort"), "facts")
    ranks = centred_ranks(dealt, facts, dict(rows.dtypes))
    sums = rank_sums(ranks, parts, -(-most * parts * min(genes, 2 * TILE) // CELLS), -(-genes // TILE), dict(rows.dtypes))
    own = _sums("own", parts, F.col("block") >= 0)
    counts = facts.groupBy("cohort", "gene").agg(_sums("own", parts).alias("there"), own.alias("valued"), F.first("total").alias("total"))
    counts = counts.select("cohort", "gene", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(parts - 1)).alias("part"), "there", "valued", "total")).alias("c")).select("cohort", "gene", "c.*").filter("there > 0")

    def work(pairs: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows:
            return shape.empty_table()
        names, valued = own.column("gene").to_numpy(), own.column("valued").to_numpy().astype(float)
        order = np.argsort(names, kind="stable")
        names, valued = names[order], valued[order]
        labels = average_linkage(1 - _correlations(names, valued, float(own.column("total")[0].as_py()), pairs), 1 - cut_correlation)
        ids, counts = np.unique(labels, return_counts=True)
        kept = sorted((i for i, c in zip(ids, counts, strict=True) if c >= least_genes), key=lambda i: (-counts[ids == i][0], i))
        new = {old: k + 1 for k, old in enumerate(kept)}
        first = {k: pa.array([own.column(k)[0].as_py()] * len(labels), own.schema.field(k).type) for k in ("cohort", "part")}
        return pa.table(first | {"gene": names.tolist(), "module_id": pa.array([new.get(x, 0) for x in labels], pa.int32())})

    shape = pa.schema([("cohort", pa.string()), ("part", pa.int32()), ("gene", pa.string()), ("module_id", pa.int32())])
    keys = ["cohort", "part"]
    return sums.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInArrow(work, "cohort string, part int, gene string, module_id int")


def _sums(flags: str, parts: int, where: Column | None = None) -> Column:
    """Sums of a column of lists, place by place."""
    own = [F.col(flags)[k].cast("bigint") for k in range(parts)]
    return F.array(*[F.sum(x if where is None else F.when(where, x).otherwise(0)) for x in own])


def value_blocks(rows: DataFrame, parts: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a value, dealt into blocks (cohort, gene, block, salt) in the order of values; and each block's facts.

    Quantiles part a gene's values: between two of them lies a block of an even number, and a quantile itself
    is a block of one value (odd), which may be frequent and is split by salt. Facts: cohort, gene, block, salts, and of each part
    the samples in the block (own) and below it (start). Block -1 holds rows without a value.
    """
    blocks = max(2, blocks)
    keys = ["cohort", "gene"]
    cuts = rows.filter("z is not null").groupBy(*keys).agg(F.percentile_approx("z", F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), 100 * blocks).alias("cuts"))
    low = 2 * F.size(F.filter("cuts", lambda c: c < F.col("z"))) + F.array_contains("cuts", F.col("z")).cast("int")
    placed = rows.join(F.broadcast(cuts), keys, "left").withColumn("block", F.when(F.col("z").isNull(), -1).otherwise(low)).drop("cuts")
    facts = placed.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), _sums("inside", parts).alias("own"))
    before = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = F.array(*[F.coalesce(F.sum(F.when(F.col("block") >= 0, F.col("own")[k])).over(before), F.lit(0)) for k in range(parts)])
    salts = F.when(F.col("block") % 2 == 1, F.ceil(F.col("n") / VALUES)).otherwise(1).cast("int")
    facts = written(facts.select(*keys, "block", salts.alias("salts"), "own", start.alias("start")), "blocks")
    heavy = facts.filter("salts > 1").select(*keys, "block", "salts")
    salted = placed.filter("block >= 0").join(F.broadcast(heavy), [*keys, "block"], "left")
    return salted.withColumn("salt", F.pmod(F.xxhash64("sample_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"), facts


def centred_ranks(dealt: DataFrame, facts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(cohort, sample_id, gene, x): of each part, samples with a smaller value minus those with a larger one (missing ones are
    larger); this is twice the centred average rank. NULL where the sample is not in the part."""
    keys = ["cohort", "gene", "block", "salt"]

    def work(rows: pa.Table, fact: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["cohort", "sample_id", "gene"]).append_column("x", pa.array([], pa.list_(pa.int32())))
        own, start, total = (np.array(fact.column(k)[0].as_py()) for k in ("own", "start", "total"))
        parts, z = len(own), rows.column("z").to_numpy()
        member = rows.column("inside").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, parts)
        if rows.column("block")[0].as_py() % 2:
            low, high = np.zeros(parts, np.int64), own
        else:
            order = np.argsort(z, kind="stable")
            upto = np.concatenate((np.zeros((1, parts), np.int64), np.cumsum(member[order], axis=0)))
            low, high = (upto[np.searchsorted(z[order], z, side)] for side in ("left", "right"))
        x = np.broadcast_to(2 * start + low + high - total, member.shape).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, parts, dtype=np.int32)), pa.array(x.ravel(), mask=~member.ravel()))
        return pa.table({"cohort": rows.column("cohort"), "sample_id": rows.column("sample_id"), "gene": rows.column("gene"), "x": lists})

    every = facts.filter("block >= 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    shape = f"cohort {kinds['cohort']}, sample_id {kinds['sample_id']}, gene {kinds['gene']}, x array<int>"
    return dealt.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(work, shape)


def rank_sums(ranks: DataFrame, parts: int, blocks: int, tiles: int, kinds: dict[str, str]) -> DataFrame:
    """cohort, part, a, b, n, sa, sb, sab of genes a <= b over the samples of a part that have both; by blocks of samples and tiles of genes."""
    t = F.pmod(F.xxhash64("gene"), F.lit(max(1, tiles))).cast("int")
    dealt = ranks.withColumns({"_block": F.pmod(F.xxhash64("sample_id"), F.lit(max(1, blocks))).cast("int"), "_t": t})
    dealt = dealt.withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(max(1, tiles) - 1)))).select("cohort", "_block", F.least("_t", "_u").alias("_t1"), F.greatest("_t", "_u").alias("_t2"), "_t", "sample_id", "gene", "x")

    def work(group: pa.Table) -> pa.Table:
        samples, row = _coded(group.column("sample_id"))
        genes, col = _coded(group.column("gene"))
        names = genes.to_numpy(zero_copy_only=False)
        order = np.argsort(names, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names, col = names[order], place[col]
        tile = np.zeros(len(names), np.int64)
        tile[col] = group.column("_t").to_numpy()
        cells = row.astype(np.int64) * len(names) + col
        if len(np.unique(cells)) < len(cells):
            raise ValueError("a sample has a gene twice: keep one")
        flat = group.column("x").combine_chunks().flatten()
        x = flat.fill_null(0).to_numpy().reshape(-1, parts)
        m = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, parts)
        i, j = np.triu_indices(len(names))
        if group.column("_t1")[0].as_py() != group.column("_t2")[0].as_py():  # pairs within a tile have a group of their own
            apart = tile[i] != tile[j]
            i, j = i[apart], j[apart]
        sums: dict[str, list] = {k: [] for k in ("n", "sa", "sb", "sab")}
        for k in range(parts):
            xs, ms = np.zeros(len(samples) * len(names)), np.zeros(len(samples) * len(names))
            xs[cells], ms[cells] = x[:, k], m[:, k]
            xs, ms = xs.reshape(-1, len(names)), ms.reshape(-1, len(names))
            for name, v in (("n", ms.T @ ms), ("sa", xs.T @ ms), ("sb", ms.T @ xs), ("sab", xs.T @ xs)):
                sums[name].append(v[i, j])
        first = pa.array([group.column("cohort")[0].as_py()] * (len(i) * parts), group.schema.field("cohort").type)
        pairs = {k: pa.array(np.tile(names[at], parts), group.schema.field("gene").type) for k, at in (("a", i), ("b", j))}
        return pa.table({"cohort": first, "part": pa.array(np.repeat(np.arange(parts, dtype=np.int32), len(i)))} | pairs | {k: np.concatenate(v) for k, v in sums.items()})

    shape = f"cohort {kinds['cohort']}, part int, a {kinds['gene']}, b {kinds['gene']}, n double, sa double, sb double, sab double"
    each = dealt.groupBy("cohort", "_block", "_t1", "_t2").applyInArrow(work, shape)
    return each.groupBy("cohort", "part", "a", "b").agg(*[F.sum(k).alias(k) for k in ("n", "sa", "sb", "sab")])


def _correlations(names: np.ndarray, valued: np.ndarray, total: float, pairs: pa.Table) -> np.ndarray:
    """Spearman correlations of genes in the order of their names, from sums over the samples that have both; ones on the diagonal.

    A gene's missing values have the rank number of its values (`valued`) each, and all of its ranks add up to 0.
    """
    size = len(names)
    n, own, product = (np.zeros((size, size)) for _ in range(3))
    a, b = (np.searchsorted(names, c) for c in (pairs.column("a").to_numpy(), pairs.column("b").to_numpy()))
    known = np.append(names, None)
    good = (known[a] == pairs.column("a").to_numpy()) & (known[b] == pairs.column("b").to_numpy())
    a, b = a[good], b[good]
    n[a, b] = n[b, a] = pairs.column("n").to_numpy()[good]
    own[a, b], own[b, a] = pairs.column("sa").to_numpy()[good], pairs.column("sb").to_numpy()[good]
    product[a, b] = product[b, a] = pairs.column("sab").to_numpy()[good]
    alone = (-(total - valued) * valued)[:, None] - own  # a gene's ranks where it is there and the other isn't
    missing = total - valued[:, None] - valued[None, :] + n
    s = product + alone * valued[None, :] + (alone * valued[None, :]).T + missing * np.outer(valued, valued)
    scale = np.sqrt(np.outer(np.diag(s), np.diag(s)))
    c = np.clip(np.where(scale > 0, s / np.where(scale > 0, scale, 1), 0), -1, 1)
    np.fill_diagonal(c, 1)
    return c


def sign_concordance(edges: DataFrame, reference: str, external: str) -> DataFrame:
    """Share of gene pairs with the same sign of correlation in both cohorts, over pairs without a zero."""
    a = edges.filter(F.col("cohort") == reference).select("module_label", "i", "j", F.col("r").alias("a"))
    b = edges.filter(F.col("cohort") == external).select("module_label", "i", "j", F.col("r").alias("b"))
    both = a.join(b, ["module_label", "i", "j"]).filter("a != 0 and b != 0")
    return both.groupBy("module_label").agg(F.count(F.lit(1)).alias("n_edges"), F.avg((F.signum("a") == F.signum("b")).cast("double")).alias("sign_concordance"))


def null_position(null: DataFrame, value: str, observed: str, *keys: str) -> DataFrame:
    """Percentile of the observed value in its null, and p = (1 + #{null >= observed}) / (1 + n)."""
    n = F.count(value)
    return null.groupBy(*keys).agg(n.alias("n_null"), F.avg((F.col(value) <= F.col(observed)).cast("double")).alias("percentile"), ((1 + F.count(F.when(F.col(value) >= F.col(observed), 1))) / (1.0 + n)).alias("p_value"))


def probe_quality(probes: DataFrame, probe: str, value: str, detection: str) -> DataFrame:
    """Per probe: mean, median, variance, sd of values; median, mean and shares of detection p below 0.01 and 0.05."""
    d = F.col(detection)
    return probes.groupBy(probe).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("sd"),
        F.median(d).alias("detection_median"), F.avg(d).alias("detection_mean"), F.avg((d < 0.01).cast("double")).alias("detected_01"), F.avg((d < 0.05).cast("double")).alias("detected_05"))


def sample_quality(probes: DataFrame, sample: str, detection: str) -> DataFrame:
    """Per sample: probes, how many are detected at 0.01 and 0.05, and their shares."""
    d = F.col(detection)
    return probes.groupBy(sample).agg(F.count(F.lit(1)).alias("n_probes"), F.count(F.when(d < 0.01, 1)).alias("n_detected_01"), F.count(F.when(d < 0.05, 1)).alias("n_detected_05"), F.avg((d < 0.01).cast("double")).alias("share_01"), F.avg((d < 0.05).cast("double")).alias("share_05"))
