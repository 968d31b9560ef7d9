"""Matched random gene panels as controls of a frozen program."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A genome's genes, not a corpus: more than that raises.
MOST_GENES = 200_000


def matched_panels(spark: SparkSession, binned: DataFrame, modules: DataFrame, panels: int, seed: int) -> DataFrame:
    """(module_label, panel, gene): per module gene one unused gene of its bin, else any unused gene.

    `binned`: gene, bin. Module genes are never drawn. One sequential random stream, so the schedule is
    made on the driver from the (bounded) gene list and then spread.
    """
    genes = binned.select("gene", "bin").limit(MOST_GENES + 1).collect()
    if len(genes) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    bin_of = {r["gene"]: r["bin"] for r in genes}
    members: dict[str, list[str]] = {}
    for r in modules.select("module_label", "gene").orderBy("module_label", "gene").collect():
        members.setdefault(r["module_label"], []).append(r["gene"])
    rng, rows = np.random.default_rng(seed), []
    for label, own in members.items():
        pool = sorted(set(bin_of) - set(own))
        by_bin: dict[object, list[str]] = {}
        for g in pool:
            by_bin.setdefault(bin_of[g], []).append(g)
        for panel in range(panels):
            used: set[str] = set()
            for g in own:
                free = [x for x in by_bin.get(bin_of.get(g), []) if x not in used] or [x for x in pool if x not in used]
                if not free:
                    raise ValueError(f"too few genes for a panel of {label}")
                chosen = free[int(rng.integers(len(free)))]
                used.add(chosen)
                rows.append((label, panel, chosen))
    return spark.createDataFrame(rows, "module_label string, panel int, gene string")


def panel_scores(z: DataFrame, panels: DataFrame) -> DataFrame:
    """Mean z of each panel and sample: cohort, module_label, panel, sample_id, score."""
    return z.select("cohort", "sample_id", "gene", "z").join(panels, "gene").groupBy("cohort", "module_label", "panel", "sample_id").agg(F.avg("z").alias("score"))
