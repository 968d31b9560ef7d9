"""Steps that must not grow faster than their input, each against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import stats
from scoreloom.operators import moments, outcomes, preservation, profiles, recurrence, resampling, stability, standardize


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_q_values_take_one_pass_over_a_family(spark):
    rng = np.random.default_rng(1)
    p = [None if k % 7 == 0 else float(x) for k, x in enumerate(np.round(rng.random(300) ** 2, 2))]
    df = spark.createDataFrame([(k % 2, k, x) for k, x in enumerate(p)], "f int, k int, p double")
    out = stats.benjamini_hochberg(df, "p", "f", order="k")
    assert "currentrow$(), unboundedfollowing$()" not in plan(out)  # such a frame is run anew at every row
    got = {r["k"]: r["q_value"] for r in out.collect()}
    for f in (0, 1):
        own = sorted((x, k) for k, x in enumerate(p) if k % 2 == f and x is not None)
        best = 1.0
        for place in range(len(own), 0, -1):
            best = min(best, own[place - 1][0] * len(own) / place)
            assert got[own[place - 1][1]] == pytest.approx(best, abs=1e-15)
    assert all(got[k] is None for k, x in enumerate(p) if x is None)


def test_sign_tests_hold_every_family_once(spark, tmp_path):
    """Families up to 1000 differences are in sign_test, as in its SQL, larger ones in sign_test_large."""
    import duckdb

    from scoreloom.plans import registry

    rows = spark.range(1, 4001).select(F.col("id").alias("p_partkey"), F.when(F.col("id") <= 900, "a").when(F.col("id") <= 1500, "b").otherwise("c").alias("p_type"), (900 + F.col("id") % 1000 / 10.0).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    seen = []
    for name, families in (("sign_test", ["a", "b"]), ("sign_test_large", ["c"])):
        got = sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(registry.ORACLE_SQL[name]).fetchall())
        assert [r[0] for r in got] == families
        seen += got
    assert len(seen) == 3


@pytest.mark.parametrize("size", [1, 4096])
def test_concordance_has_no_window_and_counts_every_pair(spark, monkeypatch, size):
    monkeypatch.setattr(outcomes, "ROWS", size)
    rng = np.random.default_rng(2)
    rows = [("a", float(t), int(e), float(s)) for t, e, s in zip(rng.integers(0, 300, 900), rng.random(900) < 0.5, np.round(rng.random(900), 2), strict=True)]
    rows += [("b", float(t), 1, 1.0) for t in range(20)] + [("b", 7.0, 0, 0.5)] * 300 + [("c", 1.0, 1, 2.0)] * 3 + [("d", 1.0, 0, 2.0), ("d", 2.0, 0, 2.0)]
    out = outcomes.concordance(spark.createDataFrame(rows, "k string, t double, e int, s double"), "t", "e", "s", "k")
    assert "Window" not in plan(out)
    got = {r["k"]: (r["n_pairs"], r["c_index"]) for r in out.collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == (0, None)
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        met = [(x, y) for x in own for y in own if x[2] and x[1] < y[1]]
        assert got[k] == (len(met), pytest.approx(sum((x[3] > y[3]) + (x[3] == y[3]) / 2 for x, y in met) / len(met), abs=1e-12))


def test_exact_medians_without_all_values_at_once(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=5001), "b": rng.integers(0, 3, 4000).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)]
    out = stats.exact_median(spark.createDataFrame(rows, "k string, v double"), "v", "k")
    assert "percentile(" not in plan(out) and "median(" not in plan(out)
    assert {r["k"]: r["median"] for r in out.collect()} == {k: float(np.median(v)) for k, v in values.items()}


@pytest.fixture(scope="module")
def genes(spark):
    """A module of six genes over more samples than a block holds, and one in which samples lack genes."""
    rng = np.random.default_rng(4)
    z = {("M", g): rng.normal(size=300) for g in range(6)} | {("N", g): rng.normal(size=300) for g in range(5)}
    rows = [("external", m, f"s{k}", f"G{g}", g, float(g - 2) or 1.0, float(v[k])) for (m, g), v in z.items() for k in range(300) if m == "M" or (k + g) % 4]
    return rows, spark.createDataFrame(rows, "cohort string, module_label string, sample_id string, gene string, ord int, loading double, z double")


def test_samples_meet_no_repeat_of_split_halves(spark, genes, monkeypatch):
    monkeypatch.setattr(moments, "SAMPLES", 64)
    rows, df = genes
    rng = np.random.default_rng(5)
    draws = {(m, rep): rng.permutation(n) for m, n in (("M", 6), ("N", 5)) for rep in range(7)}
    schedule = spark.createDataFrame([(m, rep, p, int(i)) for (m, rep), idx in draws.items() for p, i in enumerate(idx)], "module_label string, rep int, pos int, idx int")
    got = {(r["module_label"], r["rep"]): r["r"] for r in resampling.split_half(df.withColumn("pos", F.col("ord")), schedule).collect()}
    assert set(got) == set(draws)
    for (m, rep), idx in draws.items():
        half = [set(idx[: len(idx) // 2].tolist()), set(idx[len(idx) // 2 :].tolist())]
        means = []
        for k in range(300):
            own = [(r[4], (-1.0 if r[5] < 0 else 1.0) * r[6]) for r in rows if r[1] == m and r[2] == f"s{k}"]
            means.append([np.mean([v for g, v in own if g in h] or [np.nan]) for h in half])
        a, b = np.array([x for x in means if not np.isnan(x).any()]).T
        assert got[m, rep] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_components_and_correlations_come_from_blocks_of_samples(spark, genes, monkeypatch):
    monkeypatch.setattr(moments, "SAMPLES", 64)
    rows, df = genes
    some = df.filter("module_label = 'M'")
    x = np.array([[r[6] for r in rows if r[1] == "M" and r[4] == g] for g in range(6)]).T
    got = preservation.edges_by_matrix(some)
    assert "FlatMapGroupsInArrow" not in plan(got)  # the sums are kept; no group holds all samples
    assert {(r["i"], r["j"]): r["r"] for r in got.collect()} == {(i, j): pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1], abs=1e-12) for i in range(6) for j in range(i + 1, 6)}
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    w = np.array([-1.0 if g < 2 else 1.0 for g in range(6)])
    turn = np.sign(np.corrcoef(u[:, 0], x @ w)[0, 1])
    for r in preservation.leading_component(some, "external").collect():
        assert r["pc1"] == pytest.approx(turn * v[0][r["ord"]], abs=1e-9) and r["variance_explained"] == pytest.approx(s[0] ** 2 / (s**2).sum())
        assert r["orientation_correlation"] == pytest.approx(abs(np.corrcoef(u[:, 0], x @ w)[0, 1]), abs=1e-9)


def test_standardising_needs_no_window(spark):
    values = {"A": [1.0, 2.0, None, 4.0, 9.0], "B": [5.0] * 5, "C": [1.0, None, None, 3.0, 8.0], "D": [None] * 5}
    df = spark.createDataFrame([("x", f"s{k}", g, v) for g, vs in values.items() for k, v in enumerate(vs)], "cohort string, sample_id string, gene string, value double")
    out = standardize.standardised(df)
    assert "Window [" not in plan(out).split("BroadcastExchange")[0] and out.columns == [*df.columns, "z"]
    got = {(r["gene"], r["sample_id"]): r["z"] for r in out.collect()}
    for g in "AC":
        v = np.array([np.nan if x is None else x for x in values[g]])
        v = np.where(np.isnan(v), np.nanmedian(v), v)
        assert [got.pop((g, f"s{k}")) for k in range(5)] == pytest.approx(list((v - v.mean()) / v.std(ddof=1)))
    assert not got


def test_profiles_are_sent_to_a_bounded_number_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(profiles, "TILE", 2)
    monkeypatch.setattr(profiles, "CELLS", 16)
    rng = np.random.default_rng(6)
    sent = []
    monkeypatch.setattr(profiles.F, "sequence", lambda low, high, real=F.sequence: sent.append(high) or real(low, high))
    x = {c: rng.normal(size=(40, 5)) for c in ("reference", "external")}
    x["external"][3] = x["reference"][7] + 1e-3
    df = spark.createDataFrame([(c, f"{c[0]}{k:02d}", f"G{g}", float(v[k, g])) for c, v in x.items() for k in range(40) for g in range(5)], "cohort string, sample_id string, gene string, value double")
    got = {r["sample"]: r for r in profiles.profile_neighbours(df, "reference", "external").collect()}
    assert [int(str(h).split("'")[1]) for h in sent] == [profiles.SHARE - 1] * 2
    a, b = (x[c] - x[c].mean(axis=0) for c in ("external", "reference"))
    r = np.corrcoef(a, b)[:40, 40:]
    for k in range(40):
        assert got[f"e{k:02d}"]["nearest_by_centred"] == f"r{r[k].argmax():02d}" and got[f"e{k:02d}"]["maximum_centred_r"] == pytest.approx(r[k].max(), abs=1e-9)
    assert got["e03"]["suspect"]


def test_modules_of_parts_come_from_blocks(spark, monkeypatch):
    """Ranks of blocks of values and sums of blocks of samples and tiles of genes give the modules of whole parts; frequent and missing values included."""
    monkeypatch.setattr(recurrence, "VALUES", 50)
    monkeypatch.setattr(recurrence, "CELLS", 3 * 12 * 40)
    monkeypatch.setattr(recurrence, "TILE", 4)
    rng = np.random.default_rng(7)
    n, names, parts = 400, [f"g{k:02d}" for k in range(12)], 3
    x = np.repeat(rng.normal(size=(n, 4)), 3, axis=1) + 0.8 * rng.normal(size=(n, 12))
    x[:, 1] = np.maximum(x[:, 1], 0)  # half of the values are one
    x[:, 2] = np.round(x[:, 2])
    x[rng.random(n) < 0.2, 4] = np.nan
    x[:, 11] = 3.0
    lost = rng.random((n, 12)) < 0.1
    lost[:, :6] = False
    rows = [("c", f"s{i:03d}", g, None if np.isnan(x[i, k]) and i % 2 else float(x[i, k])) for i in range(n) for k, g in enumerate(names) if not lost[i, k]]
    z = spark.createDataFrame(rows, "cohort string, sample_id string, gene string, z double")
    inside = [F.substring("sample_id", 2, 3).cast("int") % 7 != k for k in range(parts)]
    x[lost] = np.nan

    def want(part):
        own = x[[i % 7 != part for i in range(n)]]
        labels = recurrence.average_linkage(1 - recurrence.spearman_matrix(own), 0.6)
        groups = sorted(({names[i] for i in np.flatnonzero(labels == k)} for k in set(labels.tolist()) if (labels == k).sum() >= 2), key=lambda g: (-len(g), min(g)))
        return {g: k + 1 for k, group in enumerate(groups) for g in group}

    got = {(r["part"], r["gene"]): r["module_id"] for r in recurrence.part_modules(z, inside, 0.4, 2).collect()}
    assert set(got) == {(k, g) for k in range(parts) for g in names}
    for part in range(parts):
        expected = want(part)
        assert len(set(expected.values())) > 2 and {g: got[part, g] for g in names} == {g: expected.get(g, 0) for g in names}
    dealt, facts = recurrence.value_blocks(z.withColumn("z", F.when(~F.isnan("z"), F.col("z"))).withColumn("inside", F.array(*inside)), parts, 8)
    groups = dealt.groupBy("gene", "block", "salt").count().collect()
    assert max(r["count"] for r in groups) <= 75 and sum(r["count"] for r in groups) == (~np.isnan(x)).sum()
    assert max(r["salts"] for r in facts.collect()) >= 4


def test_subsamples_are_the_first_by_hash(spark):
    items = spark.range(700).select(F.concat(F.lit("s"), F.col("id")).alias("i"))
    inside = stability.subsamples(items, "i", 4, 0.8, 9)
    got = items.select("i", F.array(*inside).alias("m"), F.array(*[F.xxhash64(F.lit(9), F.lit(k), "i") for k in range(4)]).alias("h")).collect()
    for k in range(4):
        first = sorted(got, key=lambda r: (r["h"][k], r["i"]))[:560]
        assert {r["i"] for r in got if r["m"][k]} == {r["i"] for r in first}
