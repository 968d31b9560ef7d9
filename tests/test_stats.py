"""Statistics against small literal cases and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import stats, symbols
from scoreloom.operators import outcomes, resampling


def bh(spark, values, **how):
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(values)], "i int, f string, p double")
    return [r["q"] for r in stats.benjamini_hochberg(df, "p", "f", order="i", q="q", **how).orderBy("i").collect()]


def test_bh_textbook(spark):
    assert bh(spark, [0.01, 0.04, 0.03, 0.002]) == pytest.approx([0.02, 0.04, 0.04, 0.008])


def test_bh_missing(spark):
    q = bh(spark, [0.01, float("nan"), 0.20, float("inf"), None, 0.04])
    assert q[1] is None and q[3] is None and q[4] is None
    assert [q[0], q[2], q[5]] == pytest.approx([0.03, 0.20, 0.06])


@pytest.mark.parametrize("bad", [-0.01, 1.01])
def test_bh_outside(spark, bad):
    with pytest.raises(Exception, match="outside"):
        bh(spark, [0.5, bad])


def test_bh_order_is_kept(spark):
    values = [0.04, 0.002, 0.03, 0.01]
    assert bh(spark, values) == pytest.approx([0.04, 0.008, 0.04, 0.02])


def test_significant(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.049, 0.05, 0.20, None)], "q double")
    assert [r[0] for r in df.select(stats.significant("q", 0.05)).collect()] == [True, True, False, False, False]
    with pytest.raises(ValueError):
        stats.significant("q", 0.0)


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 1.0), ("a", 3.0, 5.0), ("b", 1.0, 7.0), ("b", 2.0, 7.0)], "k string, x double, y double")
    ranks = df.select("k", "x", stats.average_rank("x", "k").alias("r")).filter("k = 'a'").orderBy("r").collect()
    assert [r["r"] for r in ranks] == [1.5, 1.5, 3.0]
    found = {r["k"]: r["c"] for r in df.groupBy("k").agg(stats.safe_corr("x", "y").alias("c")).collect()}
    assert found["b"] is None
    assert found["a"] == pytest.approx(np.corrcoef([1, 1, 3], [2, 1, 5])[0, 1])


def test_empirical_p(spark):
    df = spark.createDataFrame([(0, 9), (9, 9)], "c int, n int")
    assert [r[0] for r in df.select(stats.empirical_p(F.col("c"), F.col("n"))).collect()] == [0.1, 1.0]
    with pytest.raises(Exception, match="count"):
        spark.createDataFrame([(10, 9)], "c int, n int").select(stats.empirical_p(F.col("c"), F.col("n"))).collect()


def test_inverse_normal(spark):
    from statistics import NormalDist

    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    assert [r[0] for r in df.select(stats.inverse_normal(F.col("p"))).collect()] == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-8)


def test_quantile_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 6, 7, 8)], "x double")
    got = [r["bin"] for r in stats.quantile_bins(df, "x", 4).orderBy("x").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3]


def test_symbols(spark):
    rows = ["tp53.1", "NaN", "ENSCAFG1|geneb.2", "ENSCAFG1|ENSCAFG2", "|", " gene ", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(symbols.cleaned(F.col("s"))).collect()]
    assert got == ["TP53", "", "GENEB", "ENSCAFG2", "|", "GENE", ""]
    assert [r[0] for r in spark.createDataFrame([("Yes",), ("0",), (None,)], "s string").select(symbols.parsed_boolean(F.col("s"))).collect()] == [True, False, None]
    assert spark.createDataFrame([("a; b;A;;",)], "s string").select(symbols.symbol_list(F.col("s"))).first()[0] == ["A", "B"]


def test_auc_and_concordance(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 9, 60).astype(float)
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(y, s)], "k string, y int, s double")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y == 1] for b in s[y == 0]]
    assert outcomes.roc_auc(df, "s", "y", "k").first()["auc"] == pytest.approx(np.mean(pairs))
    t = rng.integers(1, 20, 60).astype(float)
    df = spark.createDataFrame([("k", float(a), int(b), float(c)) for a, b, c in zip(t, y, s)], "k string, t double, e int, s double")
    want = [(1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0) for i in range(60) for j in range(60) if t[i] < t[j] and y[i]]
    got = outcomes.concordance(df, "t", "e", "s", "k").first()
    assert (got["n_pairs"], got["c_index"]) == (len(want), pytest.approx(np.mean(want)))


def test_sign_flip(spark):
    df = spark.createDataFrame([("a", x) for x in (0.3, 0.1, 0.4, 0.2, 0.5, 0.6)], "k string, d double")
    assert resampling.sign_flip(df, "d", "k").first()["p_value"] == 2 ** -5


def test_permutations_match_a_loop(spark):
    rng = np.random.default_rng(1)
    e, f = rng.normal(size=8), rng.normal(size=8)
    schedule = resampling.permutation_schedule(spark, {"m": 8}, {"m": 11}, 37)
    pairs = spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(zip(e, f))], "module_label string, pos int, external double, frozen double")
    got = resampling.loading_permutation(pairs, schedule).first()
    rank = lambda v: np.argsort(np.argsort(v)) + 1.0
    stream, re, rf = np.random.default_rng(11), rank(e), rank(f)
    observed = np.corrcoef(re, rf)[0, 1]
    hits = sum(abs(np.corrcoef(re[stream.permutation(8)], rf)[0, 1]) >= abs(observed) - 1e-12 for _ in range(37))
    assert (got["extreme_count"], got["n_permutations"], got["observed"]) == (hits, 37, pytest.approx(observed))


def test_split_half_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    z, loading = rng.normal(size=(5, 6)), rng.normal(size=6)
    genes = spark.createDataFrame([("m", str(s), g, float(loading[g]), float(z[s, g])) for s in range(5) for g in range(6)], "module_label string, sample_id string, pos int, loading double, z double")
    schedule = resampling.permutation_schedule(spark, {"m": 6}, {"m": 77}, 37)
    got = sorted(r["r"] for r in resampling.split_half(genes, schedule).collect())
    stream, sgn, want = np.random.default_rng(77), np.where(loading < 0, -1, 1), []
    for _ in range(37):
        p = stream.permutation(6)
        want.append(np.corrcoef((z * sgn)[:, p[:3]].mean(1), (z * sgn)[:, p[3:]].mean(1))[0, 1])
    assert got == pytest.approx(sorted(want))


def test_seeds():
    assert [resampling.permutation_seeds(i) for i in range(3)] == [(42, 43, 44), (142, 143, 144), (242, 243, 244)]
    with pytest.raises(ValueError):
        resampling.permutation_seeds(-1)


def test_maps_and_rules(spark):
    df = spark.createDataFrame([("a",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(symbols.mapped(F.col("s"), {"a": 1, "b": 2}, 0)).collect()] == [1, 0, 0]
    rules = [("^run_", "runner"), ("test", "test")]
    names = spark.createDataFrame([("run_test.py",), ("my_test.py",), ("x.py",)], "s string")
    assert [r[0] for r in names.select(symbols.first_rule(F.col("s"), rules, "other")).collect()] == ["runner", "test", "other"]


def test_sample_columns(spark):
    from scoreloom.sources.tables import sample_columns

    df = spark.createDataFrame([("g", "1", "2", "x"), ("h", "3", "4", "5")], "gene string, a string, b string, c string")
    assert sample_columns(df, least=2) == ["a", "b"]
    assert sample_columns(df.withColumnRenamed("c", "GSM1"), least=1) == ["GSM1"]
    with pytest.raises(ValueError):
        sample_columns(df, least=3)


def test_student_p(spark):
    """Closed forms for one and two degrees of freedom, and a tabulated value."""
    rows = [(t, 1.0, 1 - 2 / np.pi * np.arctan(t)) for t in (0.0, 0.5, 3.0, 12.706205)] + [(t, 2.0, 1 - t / np.sqrt(t * t + 2)) for t in (0.1, 2.0, 9.0)] + [(2.0, 10.0, 0.07338803)]
    rows = [tuple(map(float, r)) for r in rows]
    got = spark.createDataFrame(rows, "t double, df double, want double").select("want", stats.student_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r["p"] - r["want"]) < 1e-6 for r in got)


def test_concordance_counts_all_pairs(spark):
    import random

    from scoreloom.operators import outcomes

    r = random.Random(4)
    rows = [(k, float(r.randint(0, 12)), r.randint(0, 1), float(r.randint(0, 6))) for k in ("a", "b") for _ in range(60)] + [("c", 1.0, 1, 2.0), ("c", 2.0, 0, None)]
    got = {x["k"]: (x["n_pairs"], x["c_index"]) for x in outcomes.concordance(spark.createDataFrame(rows, "k string, t double, e int, s double"), "t", "e", "s", "k").collect()}
    for k in ("a", "b"):
        some = [x for x in rows if x[0] == k]
        pairs = [(x, y) for x in some for y in some if x[2] and x[1] < y[1]]
        won = sum(1.0 if x[3] > y[3] else 0.5 if x[3] == y[3] else 0.0 for x, y in pairs)
        assert got[k][0] == len(pairs) and abs(got[k][1] - won / len(pairs)) < 1e-12


def test_random_flips_and_splits(spark):
    from scoreloom.operators import resampling

    rows = [("many", 0.5 + (i % 5) / 10) for i in range(25)] + [("balanced", (-1.0) ** i * (1 + i // 2)) for i in range(24)] + [("few", 1.0), ("few", 2.0)]
    got = {r["k"]: (r["p_value"], r["n_pairs"]) for r in resampling.sign_flip(spark.createDataFrame(rows, "k string, d double"), "d", "k", flips=2000).collect()}
    assert got["few"] == (0.5, 2)
    assert got["many"][1] == 25 and got["many"][0] <= 2 / 2001
    assert got["balanced"] == (1.0, 24)
    assert len(resampling.balanced_splits(6)) == 20
    drawn = resampling.balanced_splits(14, repeats=50)
    assert len(drawn) == 50 and all(len(set(x)) == 7 for x in drawn) and drawn == resampling.balanced_splits(14, repeats=50)
    found = spark.createDataFrame([("m", v) for v in (-0.1, 0.2, 0.4, None)], "module_label string, r double")
    row = resampling.split_summary(found).first()
    assert row["n_splits"] == 3 and abs(row["share_positive"] - 2 / 3) < 1e-12 and abs(row["share_above_030"] - 1 / 3) < 1e-12
