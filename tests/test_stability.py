"""Contrasts, resampled models, clusters and components against plain loops."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import stats
from scoreloom.operators import inference, inventory, outcomes, recurrence, stability
from tests.test_models import plain_cox, sample
from tests.test_panels import rank, slow_linkage, spearman


def adjusted(p):
    """Plain step-up q values by key; missing p stay missing."""
    known, low, q = sorted((v, k) for k, v in p.items() if v is not None), 1.0, dict.fromkeys(p)
    for i in range(len(known), 0, -1):
        low = min(low, known[i - 1][0] * len(known) / i)
        q[known[i - 1][1]] = low
    return q


def flips(d):
    """Share of all sign choices whose mean is as far from 0."""
    return np.mean([abs(np.dot(s, d)) >= abs(sum(d)) - 1e-12 * len(d) for s in itertools.product((1, -1), repeat=len(d))])


def drawn(schedule, values):
    """Means of the draws of each repeat."""
    n, means = len(values), {}
    for rep, pos, idx in schedule:
        if pos < n:
            means.setdefault(rep, []).append(values[idx % n])
    return [np.mean(m) for m in means.values()]


def test_paired_contrasts(spark):
    rng = np.random.default_rng(1)
    bulk = {(d, t): float(rng.normal(0.6 * k, 1)) for d in range(8) for k, t in enumerate("abc") if (d, t) not in ((0, "a"), (5, "c"))}
    schedule = [(r, p, int(rng.integers(1 << 20))) for r in range(40) for p in range(8)]
    contrasts = [("a", "b"), ("b", "c"), ("a", "none"), ("c", "a")]
    got = inference.paired_contrasts(spark.createDataFrame([(d, t, m) for (d, t), m in bulk.items()], "donor int, kind string, mean double"), "donor", "kind", contrasts, spark.createDataFrame(schedule, "rep int, pos int, idx long")).orderBy("contrast").collect()
    want, p = {}, {}
    for i, (a, b) in enumerate(contrasts):
        d = [bulk[k, a] - bulk[k, b] for k in range(8) if (k, a) in bulk and (k, b) in bulk]
        want[i], p[i] = d, flips(d) if d else None
    q = adjusted(p)
    assert [(r["a"], r["b"]) for r in got] == contrasts
    for r in got:
        d = want[r["contrast"]]
        assert (r["n_donors"], r["n_positive"], r["n_negative"]) == (len(d), sum(x > 0 for x in d), sum(x < 0 for x in d))
        if not d:
            assert [r[k] for k in ("mean_difference", "median_difference", "ci_low", "ci_high", "p_value", "q_value")] == [None] * 6
            continue
        means = drawn(schedule, d)
        for k, v in (("mean_difference", np.mean(d)), ("median_difference", np.median(d)), ("ci_low", np.quantile(means, 0.025)), ("ci_high", np.quantile(means, 0.975)), ("p_value", p[r["contrast"]]), ("q_value", q[r["contrast"]])):
            assert r[k] == pytest.approx(v), k


def test_contrast_tiers(spark):
    rng = np.random.default_rng(2)
    folds = [(e, m, model, rep, f, 0.6 + gain * (e == "OS") + float(rng.normal(0, 0.02))) for e in ("OS", "DFI") for m in "AB" for model, gain in (("x", 0.05), ("y", 0.0), ("w", 0.01)) for rep in range(7) for f in range(4) if (m, model, rep) != ("B", "w", 6)]
    schedule = [(r, p, int(rng.integers(1 << 20))) for r in range(50) for p in range(7)]
    contrasts = [("x", "y"), ("w", "y"), ("y", "absent")]
    got = inference.contrast_tiers(spark.createDataFrame(folds, "endpoint string, module_label string, model string, repeat int, fold int, c_index double"), contrasts, spark.createDataFrame(schedule, "rep int, pos int, idx long")).collect()
    means, want = {}, {}
    for e, m, model, rep, _, c in folds:
        means.setdefault((e, m, model, rep), []).append(c)
    for e, m, (a, b) in itertools.product(("OS", "DFI"), "AB", contrasts[:2]):
        d = [np.mean(means[e, m, a, r]) - np.mean(means[e, m, b, r]) for r in range(7) if (e, m, a, r) in means and (e, m, b, r) in means]
        ranks = rank(np.abs(d))
        sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        w = sum(r for r, x in zip(ranks, d) if x > 0)
        p = min(1, 2 * min(np.mean([s >= w for s in sums]), np.mean([s <= w for s in sums])))
        mean, share, low = np.mean(d), np.mean([x > 0 for x in d]), np.quantile(drawn(schedule, d), 0.025)
        tier = "strong" if mean >= 0.02 and share >= 0.75 and low > 0 else "moderate" if mean >= 0.01 and share >= 0.6 else "weak_positive" if mean > 0 else ""
        want[e, m, a, b] = (len(d), mean, share, low, p, f"{tier}_descriptive_support" if tier else "no_consistent_positive_support")
    q = {e: adjusted({k: v[4] for k, v in want.items() if k[0] == e}) for e in ("OS", "DFI")}
    assert len(got) == len(want) and len({v[5] for v in want.values()}) >= 3
    for r in got:
        k = tuple(r[c] for c in ("endpoint", "module_label", "model_a", "model_b"))
        n, mean, share, low, p, tier = want[k]
        assert (r["n_repeats"], r["support"]) == (n, tier)
        for c, v in (("mean_delta", mean), ("fraction_positive", share), ("ci_low", low), ("p_value", p), ("q_value", q[k[0]][k])):
            assert r[c] == pytest.approx(v), c


def coefficient(t, e, s):
    return float(plain_cox(t, e, ((s - s.mean()) / s.std(ddof=1))[:, None])[0][0])


def survival(spark, n, seed):
    t, e, s, _ = sample(n, seed)
    return t, e, s, spark.createDataFrame([(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(t, e, s))], "sample int, t double, e int, s double")


def test_draws_keep_strata_and_bootstrapped_models_equal_plain_ones(spark):
    t, e, s, rows = survival(spark, 40, 11)
    reps = {}
    for r in stability.stratified_draws(rows, "sample", "e", 12, 5).collect():
        reps.setdefault(r["rep"], []).append(r["sample"])
    assert len(reps) == 12 and len({tuple(sorted(v)) for v in reps.values()}) == 12
    assert all(sorted(e[v]) == sorted(e) for v in map(np.array, reps.values()))
    b = [coefficient(t[v], e[v], s[v]) for v in map(np.array, reps.values())]
    got = stability.bootstrap_cox(rows, "sample", "t", "e", "s", 12, 5).first()
    assert got["repeats"] == 12 and got["share_positive"] == np.mean(np.array(b) > 0)
    for k, v in (("median", np.median(b)), ("low", np.quantile(b, 0.025)), ("high", np.quantile(b, 0.975))):
        assert got[k] == pytest.approx(v, rel=1e-7)


def test_models_without_each_sample(spark):
    t, e, s, rows = survival(spark, 26, 12)
    b = [coefficient(np.delete(t, i), np.delete(e, i), np.delete(s, i)) for i in range(26)]
    got = stability.leave_one_out_cox(rows, "sample", "t", "e", "s").first()
    assert got["n_fits"] == 26 and got["sign_holds"] == (min(b) * max(b) > 0)
    assert got["smallest"] == pytest.approx(min(b), rel=1e-7) and got["largest"] == pytest.approx(max(b), rel=1e-7)


def test_modules_of_subsamples(spark):
    """Samples by the order of their hashes; clusters, indices and means by plain loops."""
    rng = np.random.default_rng(4)
    n, names = 14, [f"g{i}" for i in range(9)]
    x = np.repeat(rng.normal(size=(n, 3)), 3, axis=1) + 0.7 * rng.normal(size=(n, 9))
    z = spark.createDataFrame([(f"s{i:02d}", g, float(x[i, k])) for i in range(n) for k, g in enumerate(names)], "sample_id string, gene string, z double")
    frozen = {"A": {"g0", "g1", "g2"}, "B": {"g3", "g4", "q"}, "C": {"q", "r"}}
    got = stability.subsample_modules(z, spark.createDataFrame([(m, g) for m, v in frozen.items() for g in v], "module_label string, gene string"), 6, 0.6, 0.5, 2, seed=9).collect()
    hashes = spark.range(6).crossJoin(z.select("sample_id").distinct()).select(F.col("id").cast("int").alias("rep"), "sample_id").select("rep", "sample_id", F.xxhash64(F.lit(9), "rep", "sample_id").alias("h")).collect()
    scores = {m: [] for m in frozen}
    for rep in range(6):
        chosen = sorted(int(r["sample_id"][1:]) for r in sorted((r for r in hashes if r["rep"] == rep), key=lambda r: (r["h"], r["sample_id"]))[: math.ceil(0.6 * n)])
        part = x[chosen]
        r = np.array([[spearman(part[:, a], part[:, b]) for b in range(9)] for a in range(9)])
        labels = slow_linkage(1 - r, 0.5)
        found = [{names[i] for i in np.flatnonzero(labels == k)} for k in set(labels) if (labels == k).sum() >= 2]
        for m, v in frozen.items():
            both = [(len(v & f) / len(v | f), 2 * len(v & f) / (len(v) + len(f))) for f in found if v & f]
            scores[m].append((bool(both), max((j for j, _ in both), default=0.0), max((f for _, f in both), default=0.0)))
    assert {r["module_label"] for r in got} == set(frozen)
    for r in got:
        matched, jaccard, f1 = zip(*scores[r["module_label"]])
        assert (r["n_matched"], r["mean_jaccard"], r["median_jaccard"], r["mean_f1"]) == (sum(matched), pytest.approx(np.mean(jaccard)), pytest.approx(np.median(jaccard)), pytest.approx(np.mean(f1)))


def test_rediscovery_null(spark):
    found = {"1": {"a", "b", "c"}, "2": {"d", "e"}}
    frozen = {"M": {"a", "b"}, "N": {"x"}, "O": {"d", "e", "f", "g"}}
    panels = {("M", 0): {"a", "d"}, ("N", 0): {"x"}, ("M", 1): {"x", "y"}, ("N", 1): {"y"}, ("M", 2): {"d", "e"}, ("N", 2): {"a"}}

    def f1(v, f):
        return 2 * len(v & f) / (len(v) + len(f))

    null = [max(f1(v, f) for (m, p), v in panels.items() if p == k for f in found.values()) for k in range(3)]
    got = stability.rediscovery_null(
        spark.createDataFrame([(m, g) for m, v in found.items() for g in v], "module string, gene string"), spark.createDataFrame([(m, g) for m, v in frozen.items() for g in v], "module_label string, gene string"),
        spark.createDataFrame([(m, p, g) for (m, p), v in panels.items() for g in v], "module_label string, panel int, gene string")).collect()
    assert {r["module_label"] for r in got} == set(frozen)
    for r in got:
        best = max(f1(frozen[r["module_label"]], f) for f in found.values())
        assert (r["f1"], r["n_panels"], r["p_value"]) == (pytest.approx(best), 3, pytest.approx((1 + sum(v >= best for v in null)) / 4))


@pytest.mark.parametrize("anchor", [None, "g2"])
def test_component_scores(spark, anchor):
    rng = np.random.default_rng(6)
    x = rng.normal(0.4, 1, size=(9, 5)) + rng.normal(size=(9, 1))
    loads = [1.0, -1.0, 0.5, 0.0, -2.0]
    rows = [(c, "M", f"s{i}", f"g{k}", k, loads[k], float(x[i, k])) for c in ("external", "reference") for i in range(9) for k in range(5)]
    rows += [("external", "ONE", f"s{i}", "g0", 0, 1.0, float(x[i, 0])) for i in range(9)]
    genes = spark.createDataFrame(rows, "cohort string, module_label string, sample_id string, gene string, ord int, loading double, z double")

    def want(at):
        values, vectors = np.linalg.eigh(x[:, at].T @ x[:, at])
        v = x[:, at] @ vectors[:, -1]
        guide = x[:, 2] if anchor and 2 in at else x[:, at] @ np.array([-1.0 if loads[k] < 0 else 1.0 for k in at])
        v = v if np.corrcoef(v, guide)[0, 1] >= 0 else -v
        return (v - v.mean()) / v.std(ddof=1)

    got = {(r["module_label"], r["sample_id"]): r["score"] for r in stability.component_scores(genes, "external", anchor).collect()}
    assert len(got) == 18 and all(got["ONE", f"s{i}"] is None for i in range(9))
    assert [got["M", f"s{i}"] for i in range(9)] == pytest.approx(want([0, 1, 2, 3, 4]))
    apart = stability.component_scores(genes, "external", anchor, without=spark.createDataFrame([("g0",), ("g4",)], "gene string")).collect()
    assert {r["module_label"] for r in apart} == {"M"}
    assert [r["score"] for r in sorted(apart, key=lambda r: r["sample_id"])] == pytest.approx(want([1, 2, 3]))


def test_table_probe(spark):
    rows = [(1, "a"), (2, None), (1, "a"), (3, "c")]
    one, other, less = (inventory.table_probe(spark.createDataFrame(r, "k int, v string")).first() for r in (rows, rows[::-1], rows[1:]))
    assert (one["n_rows"], one["columns"], one["n_columns"]) == (4, "k;v", 2)
    assert one["digest"] == other["digest"] != less["digest"]


def test_rank_gaussian(spark):
    """Ties share a rank, missing values count as the median, a constant group is 0."""
    groups = {"a": [3.0, 1.0, None, 1.0, 9.0, 2.0, 2.0], "b": [5.0, 5.0], "c": [float(i * i % 31) for i in range(25)]}
    rows = [(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)]
    got = {(r["k"], r["i"]): r["gaussian"] for r in stats.rank_gaussian(spark.createDataFrame(rows, "k string, i int, v double"), "v", "k").collect()}
    for k, vs in groups.items():
        filled = [np.median([x for x in vs if x is not None]) if v is None else v for v in vs]
        for i, r in enumerate(rank(filled)):
            assert got[k, i] == pytest.approx(0.0 if len(set(filled)) == 1 else NormalDist().inv_cdf((r - 0.5) / len(vs)), abs=1e-8)


def test_corrected_t(spark):
    """Five values with t of known p: 4 degrees of freedom have a closed form."""
    groups = {"a": [0.1, 0.3, -0.05, 0.2, 0.15], "same": [0.2, 0.2, 0.2], "one": [0.4], "gap": [0.5, None, 0.1, 0.3, 0.2, -0.4]}
    got = {r["k"]: r for r in outcomes.corrected_t(spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, d double"), "d", 5, "k").collect()}
    for k in ("a", "gap"):
        d = [x for x in groups[k] if x is not None]
        t = np.mean(d) / math.sqrt((1 / 5 + 1 / 4) * np.var(d, ddof=1))
        x = abs(t) / math.sqrt(4 + t * t)
        assert (got[k]["n"], got[k]["t"], got[k]["p_value"]) == (5, pytest.approx(t), pytest.approx(1 - x * (3 - x * x) / 2, rel=1e-7))
    assert got["same"]["p_value"] is None and got["one"]["p_value"] is None


def test_gene_modules_are_numbered_by_size(spark):
    rng = np.random.default_rng(13)
    sizes, names = (4, 2, 6), [f"g{i:02d}" for i in range(13)]
    data, want = [], {}
    for cohort in ("p", "q"):
        x = np.column_stack([np.repeat(rng.normal(size=(40, 3)), sizes, axis=1) + 0.3 * rng.normal(size=(40, 12)), rng.normal(size=40)])
        data += [(cohort, f"s{i}", g, float(x[i, k])) for i in range(40) for k, g in enumerate(names)]
        labels = slow_linkage(1 - np.array([[spearman(x[:, a], x[:, b]) for b in range(13)] for a in range(13)]), 0.4)
        large = sorted({k for k in labels if (labels == k).sum() >= 3}, key=lambda k: (-(labels == k).sum(), k))
        want.update({(cohort, g): large.index(k) + 1 if k in large else 0 for g, k in zip(names, labels)})
    got = {(r["cohort"], r["gene"]): r["module_id"] for r in recurrence.gene_modules(spark.createDataFrame(data, "cohort string, sample_id string, gene string, z double"), 0.6, 3).collect()}
    assert got == want and sorted(got.values()) == sorted(([1] * 6 + [2] * 4 + [0] * 3) * 2)
