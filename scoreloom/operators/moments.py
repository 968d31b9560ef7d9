"""Sums of products of items (genes) over samples, made in parts: all that correlations, components and halves need of the samples.

Blocks of samples and tiles of items give partial sums by dense products; no task holds more than a block, however
many samples there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.sources.shared import written

#: Samples to a block and items to a tile: some 30 MB a task.
SAMPLES = 4096
TILE = 512
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def pair_sums(values: DataFrame, keys: list[str], item: str, value: str = "value", samples: int | None = None, tile: int | None = None) -> DataFrame:
    """keys, a, b, n, sa, sb, saa, sbb, sab of items a <= b over samples that have both.

    `values`: keys, sample_id, item, value; at most one value of a sample and item in a key. `samples` to a block and
    items to a `tile`, else SAMPLES and TILE.
    """
    rows = written(values.filter(F.col(value).isNotNull()).select(*keys, "sample_id", F.col(item).alias("_i"), F.col(value).cast("double").alias("_v")), "values")
    sizes = rows.agg(F.approx_count_distinct("sample_id").alias("s"), F.approx_count_distinct("_i").alias("g")).first()
    blocks, tiles = -(-max(1, sizes["s"]) // (samples or SAMPLES)), -(-max(1, sizes["g"]) // (tile or TILE))
    t = F.pmod(F.xxhash64("_i"), F.lit(tiles)).cast("int")
    dealt = rows.select(*keys, F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("_block"), "sample_id", "_i", "_v", t.alias("_t"))
    dealt = dealt.withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(*keys, "_block", F.least("_t", "_u").alias("_t1"), F.greatest("_t", "_u").alias("_t2"), "_t", "sample_id", "_i", "_v")
    kinds = dict(rows.dtypes)

    def work(group: pa.Table) -> pa.Table:
        samples, row = _coded(group.column("sample_id"))
        items, col = _coded(group.column("_i"))
        tile = np.zeros(len(items), np.int64)
        tile[col] = group.column("_t").to_numpy()
        order = np.argsort(items.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(items), np.int64)
        place[order] = np.arange(len(items))
        items, tile, col = items.take(pa.array(order)), tile[order], place[col]
        x, m = np.zeros((len(samples), len(items))), np.zeros((len(samples), len(items)))
        x[row, col], m[row, col] = group.column("_v").to_numpy(), 1.0
        i, j = np.triu_indices(len(items))
        if group.column("_t1")[0].as_py() != group.column("_t2")[0].as_py():  # pairs within a tile have a group of their own
            apart = tile[i] != tile[j]
            i, j = i[apart], j[apart]
        sums = {"n": m.T @ m, "sa": x.T @ m, "sb": m.T @ x, "saa": (x * x).T @ m, "sbb": m.T @ (x * x), "sab": x.T @ x}
        same = {k: pa.array([group.column(k)[0].as_py()] * len(i), group.schema.field(k).type) for k in keys}
        return pa.table(same | {"a": items.take(pa.array(i)), "b": items.take(pa.array(j))} | {k: v[i, j] for k, v in sums.items()})

    shape = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"a {kinds['_i']}", f"b {kinds['_i']}", *(f"{k} double" for k in SUMS)])
    parts = dealt.groupBy(*keys, "_block", "_t1", "_t2").applyInArrow(work, shape)
    # small and read several times, so it is kept
    return written(parts.groupBy(*keys, "a", "b").agg(*[F.sum(k).alias(k) for k in SUMS]), "sums")


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and each row's place among them."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def correlations(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, a, b, r of pairs a < b; NULL for a constant side."""
    n, sa, sb, saa, sbb, sab = (F.col(k) for k in SUMS)
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    # a constant item's variance is rounding noise
    some = (va > 1e-12 * saa) & (vb > 1e-12 * sbb)
    return sums.filter("a < b").select(*keys, "a", "b", F.when(some, (sab - sa * sb / n) / F.sqrt(va * vb)).alias("r"))


def square(group: pa.Table) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Items in order, samples, means and centred sums of products of one key's pair sums; raises unless all samples have all items."""
    a, b, n, sa, sab = (group.column(k).to_numpy() for k in ("a", "b", "n", "sa", "sab"))
    items, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    k = len(items)
    i, j = inverse.reshape(2, -1)
    if len(n) != k * (k + 1) // 2 or n.min() != n.max():
        raise ValueError("samples that lack items: impute or leave out first")
    total, s = np.zeros(k), np.zeros((k, k))
    total[i[i == j]] = sa[i == j]
    s[i, j] = s[j, i] = sab
    return items, float(n[0]), total / n[0], s - np.outer(total, total) / n[0]
