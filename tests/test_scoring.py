"""Frozen scoring: cleaning, imputation, coverage and scores on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import preservation, scoring, standardize
from scoreloom.schemas import ScoringRule, require_columns


def expr(spark, genes, cohort="c"):
    rows = [(cohort, f"s{i}", g, k, v) for k, (g, values) in enumerate(genes) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cohort string, sample_id string, gene string, gene_ord int, value double")


def weights(spark, *rows):
    return spark.createDataFrame([("m", g, float(w), i) for i, (g, w) in enumerate(rows)], "module_label string, gene string, loading double, ord int")


def test_first_column_of_a_symbol_is_kept(spark):
    e = expr(spark, [("genea", [1.0, 2.0, 3.0]), ("GENEA", [9.0, 9.0, 9.0]), (" geneb ", [4.0, 5.0, 6.0])])
    got = sorted((r["gene"], r["value"]) for r in standardize.normalised(e).collect())
    assert got == [("GENEA", 1.0), ("GENEA", 2.0), ("GENEA", 3.0), ("GENEB", 4.0), ("GENEB", 5.0), ("GENEB", 6.0)]


def test_impute_scale_and_drop(spark):
    z = standardize.standardised(expr(spark, [("A", [1.0, 2.0, None, 4.0]), ("B", [5.0, 5.0, 5.0, 5.0]), ("C", [1.0, float("inf"), 3.0, float("nan")])]))
    rows = z.collect()
    assert {r["gene"] for r in rows} == {"A", "C"}
    a = [r["z"] for r in sorted((r for r in rows if r["gene"] == "A"), key=lambda r: r["sample_id"])]
    v = np.array([1.0, 2.0, 2.0, 4.0])
    assert a == pytest.approx((v - v.mean()) / v.std(ddof=1))


def test_scores_and_available_weights(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 3))
    e = expr(spark, [(g, x[:, k].tolist()) for k, g in enumerate("ABD")])
    w = scoring.frozen_program(weights(spark, ("a", 1), ("B", 2), ("C", 100), ("D", -1), ("A", 50), ("nan", 3)))
    z = standardize.standardised(standardize.normalised(e))
    zs = (x - x.mean(0)) / x.std(0, ddof=1)
    scale = lambda v: (v - v.mean()) / v.std(ddof=1)
    got = {(r["score_name"], r["sample_id"]): r["value"] for r in scoring.scores(standardize.normalised(e), z, w).collect()}
    for name, raw in (("signed_mean", zs @ np.array([1, 1, -1]) / 3), ("weighted", zs @ np.array([1, 2, -1]) / 4)):
        assert [got[name, f"s{i}"] for i in range(6)] == pytest.approx(scale(raw))
    c = scoring.coverage(standardize.normalised(e), z, w).first()
    assert (c["available_genes"], c["missing_genes"], c["coverage_fraction"]) == ("A;B;D", "C", 0.75)


def test_zero_loading_counts_as_positive(spark):
    df = spark.createDataFrame([(0.0,), (-2.0,), (3.0,)], "w double")
    assert [r[0] for r in df.select(scoring.sign(F.col("w"))).collect()] == [1.0, -1.0, 1.0]


@pytest.mark.parametrize(("have", "total", "ok"), [(2, 4, False), (3, 6, True), (3, 7, False)])
def test_coverage_edges(spark, have, total, ok):
    names = [f"G{i}" for i in range(total)]
    e = expr(spark, [(g, [1.0, 2.0, 4.0]) for g in names[:have]])
    w = weights(spark, *[(g, 1) for g in names])
    assert scoring.coverage(e, standardize.standardised(e), w, ScoringRule(minimum_genes=3)).first()["minimum_rule_passed"] is ok


def test_rules_raise(spark):
    with pytest.raises(ValueError):
        ScoringRule(minimum_genes=0)
    with pytest.raises(ValueError, match="x, y"):
        require_columns(spark.range(1), "y", "x", "id")
    with pytest.raises(ValueError):
        scoring.module(weights(spark, ("A", 1)), "other")


def test_edges_agree_and_monotone_edges_are_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 5))
    both = expr(spark, [(f"G{k}", x[:, k].tolist()) for k in range(5)], "reference").unionByName(expr(spark, [(f"G{k}", (3 * x[:, k] + 1).tolist()) for k in range(5)], "external"))
    genes = preservation.module_genes(standardize.standardised(both), weights(spark, *[(f"G{k}", k - 2) for k in range(5)]))
    joined, matrix = preservation.edges(genes), preservation.edges_by_matrix(genes)
    a = {(r["cohort"], r["i"], r["j"]): r["r"] for r in joined.collect()}
    b = {(r["cohort"], r["i"], r["j"]): r["r"] for r in matrix.collect()}
    assert len(a) == 20 and all(a[k] == pytest.approx(b[k]) for k in b)
    assert preservation.edge_preservation(joined, "reference", "external").first()["spearman"] == pytest.approx(1.0)
    pc = preservation.leading_component(genes, "external").collect()
    assert pc[0]["orientation_correlation"] > 0


def test_average_linkage():
    from scoreloom.operators.recurrence import average_linkage, spearman_matrix

    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    labels = average_linkage(np.abs(x[:, None] - x[None]), 1.0)
    assert [len(set(labels[a])) for a in (slice(0, 3), slice(3, 5))] == [1, 1] and len(set(labels)) == 3
    m = spearman_matrix(np.array([[1, 10, 3], [2, 20, 2], [2, 30, 1], [4, 40, 0.0]]))
    assert m[0, 0] == 1 and m[1, 2] == pytest.approx(-1)


def test_matched_panels(spark):
    from scoreloom.operators.controls import matched_panels

    binned = spark.createDataFrame([(f"G{i}", i % 3) for i in range(30)], "gene string, bin int")
    modules = spark.createDataFrame([("m", f"G{i}") for i in range(6)], "module_label string, gene string")
    rows = matched_panels(spark, binned, modules, 5, 1).collect()
    for panel in range(5):
        genes = [r["gene"] for r in rows if r["panel"] == panel]
        assert len(set(genes)) == 6 and not set(genes) & {f"G{i}" for i in range(6)}
        assert sorted(int(g[1:]) % 3 for g in genes) == [0, 0, 1, 1, 2, 2]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, matched_panels(spark, binned, modules, 5, 1).collect()))
    with pytest.raises(ValueError):
        matched_panels(spark, binned.limit(8), modules, 1, 1)
