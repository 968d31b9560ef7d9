"""Null distributions, panels, profiles, exact rank tests and clusters against plain loops."""

import itertools
import time

import numpy as np
import pytest

from scoreloom.operators import inference, panels, profiles, recurrence


def rank(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def spearman(a, b):
    return np.corrcoef(rank(a), rank(b))[0, 1]


def test_cross_cohort_audit(spark):
    """Labels of one cohort's matrix are permuted, rows and columns together."""
    rng = np.random.default_rng(1)
    n, reps = 7, 30
    ref, ext = (np.corrcoef(rng.normal(size=(20, n)), rowvar=False) for _ in range(2))
    i, j = np.triu_indices(n, 1)
    edges = [(c, "M", int(a), int(b), float(m[a, b])) for c, m in (("r", ref), ("e", ext)) for a, b in zip(i, j)]
    load, frozen = rng.normal(size=n), rng.normal(size=n)
    perms = [rng.permutation(n) for _ in range(reps)]
    schedule = [("M", k, p, int(x)) for k, perm in enumerate(perms) for p, x in enumerate(perm)]
    got = panels.cross_cohort_audit(
        spark.createDataFrame(edges, "cohort string, module_label string, i int, j int, r double"), spark.createDataFrame([("M", k, float(a), float(b)) for k, (a, b) in enumerate(zip(load, frozen))], "module_label string, pos int, external double, frozen double"),
        spark.createDataFrame(schedule, "module_label string, rep int, pos int, idx int"), "r", "e").first()
    observed = {"edge": spearman(ref[i, j], ext[i, j]), "loading": spearman(load, frozen)}
    nulls = {"edge": [spearman(ref[i, j], ext[np.ix_(p, p)][i, j]) for p in perms], "loading": [spearman(load[p], frozen) for p in perms]}
    for k, o in observed.items():
        v = np.array(nulls[k])
        assert got[f"{k}_spearman"] == pytest.approx(o)
        assert got[f"{k}_p_positive"] == pytest.approx((1 + (v >= o - 1e-12).sum()) / (reps + 1)) and got[f"{k}_p_two_sided"] == pytest.approx((1 + (abs(v) >= abs(o) - 1e-12).sum()) / (reps + 1))
        assert got[f"{k}_null_mean"] == pytest.approx(v.mean()) and got[f"{k}_null_q95"] == pytest.approx(np.quantile(v, 0.95))
    assert got["edge_sign_concordance"] == pytest.approx((np.sign(ref[i, j]) == np.sign(ext[i, j])).mean()) and got["edge_pearson"] == pytest.approx(np.corrcoef(ref[i, j], ext[i, j])[0, 1])


@pytest.mark.parametrize("tile", [512, 3])
def test_gene_correlations(spark, monkeypatch, tile):
    """With tiles of three genes and blocks of five samples; missing values and a constant gene."""
    monkeypatch.setattr(panels, "TILE", tile)
    monkeypatch.setattr(panels, "SAMPLES", 5 if tile == 3 else 4096)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(18, 8))
    x[:, 3], x[4, 5], x[:9, 6] = 0.1, np.nan, np.nan
    rows = [("c", f"s{i}", f"g{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(18) for j in range(8)]
    got = {(r["a"], r["b"]): r["r"] for r in panels.gene_correlations(spark.createDataFrame(rows, "cohort string, sample_id string, gene string, value double")).collect()}
    assert len(got) == 28
    for a, b in itertools.combinations(range(8), 2):
        ok = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        want = None if 3 in (a, b) else np.corrcoef(x[ok, a], x[ok, b])[0, 1]
        assert got[f"g{a}", f"g{b}"] == (None if want is None else pytest.approx(want))


def test_drawn_panels(spark):
    """Own bins first, then whatever is left; no gene twice; too few candidates leave no panel."""
    bins = [(f"g{k:02d}", str(k % 3)) for k in range(30)]
    modules = [("A", f"g{k:02d}", k) for k in (0, 3, 6, 1)] + [("B", f"g{k:02d}", k) for k in (2, 5)]
    binned, own = spark.createDataFrame(bins, "gene string, bin string"), spark.createDataFrame(modules, "module_label string, gene string, ord int")
    rows = panels.whole_panels(panels.drawn_panels(binned, own, 6, 1)).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, panels.drawn_panels(binned, own, 6, 1).collect()))
    of = dict(bins)
    for label, size in (("A", 4), ("B", 2)):
        for p in range(6):
            part = [r for r in rows if (r["module_label"], r["panel"]) == (label, p)]
            genes = [r["gene"] for r in part]
            assert len(part) == len(set(genes)) == size and not set(genes) & {m[1] for m in modules}
            assert all(of[r["target"]] == of[r["gene"]] for r in part)
    few = binned.filter("gene in ('g00', 'g03', 'g06', 'g01', 'g09', 'g02', 'g05', 'g04', 'g08', 'g07')")
    fallback = panels.drawn_panels(few, own, 4, 1).collect()  # one candidate of bin 0 and three others
    a = [r for r in fallback if r["module_label"] == "A" and r["panel"] == 0]
    assert sorted(r["gene"] for r in a) == ["g04", "g07", "g08", "g09"]
    assert panels.whole_panels(panels.drawn_panels(few.filter("gene != 'g08'"), own, 4, 1)).filter("module_label = 'A'").count() == 0
    assert {r["gene"] for r in panels.drawn_panels(few, own, 9, 1, within=True).filter("module_label = 'B'").collect()} & {"g00", "g03", "g06", "g01"}


@pytest.mark.parametrize("tile", [2048, 3])
def test_profile_neighbours(spark, monkeypatch, tile):
    monkeypatch.setattr(profiles, "TILE", tile)
    rng = np.random.default_rng(4)
    ref, ext = rng.normal(size=(9, 12)), rng.normal(size=(7, 12))
    ext[2] = ref[5] + 0.001
    ext[3] = 1.0
    rows = [(c, f"{c}{i}", f"g{j:02d}", float(m[i, j])) for c, m in (("r", ref), ("e", ext)) for i in range(len(m)) for j in range(12)]
    df = spark.createDataFrame(rows, "cohort string, sample_id string, gene string, value double")
    got = {r["sample"]: r for r in profiles.profile_neighbours(df, "r", "e").collect()}
    assert len(got) == 7 and got["e2"]["nearest_by_rank"] == "r5" and got["e2"]["suspect"] and got["e2"]["maximum_rank_r"] == 1
    assert got["e3"]["maximum_rank_r"] is None and got["e3"]["nearest_by_rank"] is None
    cr, ce = ref - ref.mean(0), ext - ext.mean(0)
    for k in (0, 1, 4, 5, 6):
        ranks, centred = [spearman(ext[k], v) for v in ref], [np.corrcoef(ce[k], v)[0, 1] for v in cr]
        r = got[f"e{k}"]
        assert r["maximum_rank_r"] == pytest.approx(max(ranks)) and r["nearest_by_rank"] == f"r{np.argmax(ranks)}"
        assert r["maximum_centred_r"] == pytest.approx(max(centred)) and r["nearest_by_centred"] == f"r{np.argmax(centred)}" and not r["suspect"]
    with pytest.raises(Exception, match="incomplete profile"):
        profiles.profile_neighbours(df.filter("not (sample_id = 'e1' and gene = 'g03')"), "r", "e").collect()


def test_signed_rank_is_exact(spark):
    """Small samples with ties and zeros, against all choices of signs."""
    rng = np.random.default_rng(6)
    data = {n: np.round(rng.normal(0.3, 1, size=n), 1 if n % 2 else 3) for n in (1, 2, 5, 8, 12)}
    df = spark.createDataFrame([(n, float(x)) for n, v in data.items() for x in v] + [(3, 0.0)], "k int, d double")
    got = {r["k"]: r for r in inference.signed_rank(df, "d", "k").collect()}
    assert set(got) == {k for k, v in data.items() if (v != 0).any()}
    for k, v in data.items():
        v = v[v != 0]
        ranks = rank(abs(v))
        w = ranks[v > 0].sum()
        sums = np.array([sum(c) for c in itertools.product(*[(0, r) for r in ranks])])
        up, down = (sums >= w).mean(), (sums <= w).mean()
        assert (got[k]["w_plus"], got[k]["p_greater"], got[k]["p_two_sided"]) == (w, pytest.approx(up), pytest.approx(min(1, 2 * min(up, down))))
    large = inference.signed_rank(spark.createDataFrame([(float(x),) for x in rng.normal(0.1, 1, 50)], "d double"), "d")
    near = inference.signed_rank(spark.createDataFrame([(float(x),) for x in rng.normal(0.1, 1, 50)], "d double"), "d", most_exact=0)
    assert 0 < large.first()["p_two_sided"] <= 1 and 0 < near.first()["p_two_sided"] <= 1


def slow_linkage(distance, cut):
    """The nearest pair of clusters, again and again."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        best = min((distance[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(distance), int)
    for g in groups:
        out[g] = min(g)
    return out


def test_average_linkage():
    rng = np.random.default_rng(7)
    for n, cut in ((25, 0.6), (40, 0.9), (30, 5.0), (1, 1.0)):
        x = np.corrcoef(rng.normal(size=(n, 6))) if n > 1 else np.ones((1, 1))
        assert recurrence.average_linkage(1 - x, cut).tolist() == slow_linkage(1 - x, cut).tolist()
    began = time.time()
    x = np.corrcoef(rng.normal(size=(3000, 30)))
    assert len(set(recurrence.average_linkage(1 - x, 0.6).tolist())) < 3000 and time.time() - began < 60
