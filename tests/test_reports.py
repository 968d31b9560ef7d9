"""Preservation, permutation inference and reliability from files to files, against plain loops."""

import hashlib
import json
from itertools import combinations

import numpy as np
import pytest

from scoreloom import cli
from scoreloom.operators import inference, resampling
from tests.test_cli import manifest, read
from tests.test_panels import rank, spearman

ORDER = ["B", "A", "C", "D"]
LOADS = {"A": {"G0": 0.5, "G1": -1.0, "G2": 2.0, "G3": -0.1, "G4": 0.7, "G5": 0.2}, "C": {"G1": 1.0, "X9": 2.0}, "B": {"G6": 1.0, "g7 ": -1.0, "G8|": 0.0, "G9": 0.3, "ONLY": 1.0}, "D": {"NA": 1.0}}
CLEAN = {"g7 ": "G7", "G8|": "G8"}
GENES = [f"G{i}" for i in range(10)]


@pytest.fixture
def given(tmp_path):
    """Two cohorts of files, weights with symbols to clean, and standardised values by plain loops."""
    r, paths, z = np.random.default_rng(3), {}, {}
    for name, n in (("reference", 13), ("external", 11)):
        genes = GENES + (["ONLY"] if name == "external" else [])
        x = r.normal(size=(n, 2)) @ r.normal(size=(2, len(genes))) + r.normal(size=(n, len(genes)))
        paths[name] = tmp_path / f"{name}.csv"
        paths[name].write_text("," + ",".join(genes) + "\n" + "".join(f"{name}{i}," + ",".join(map(repr, v.tolist())) + "\n" for i, v in enumerate(x)))
        z[name] = {g: (x[:, k] - x[:, k].mean()) / x[:, k].std(ddof=1) for k, g in enumerate(genes)}
    paths["weights"] = tmp_path / "w.csv"
    paths["weights"].write_text("module_label,gene,loading\n" + "".join(f"{m},{g},{x}\n" for m, v in LOADS.items() for g, x in v.items()) + "A,G0,-9\nZ,G1,1\n")
    return paths, z


def run(spark, tmp_path, paths, command, inputs, outputs, **settings):
    config = tmp_path / f"{command}.json"
    config.write_text(json.dumps({"module_order": ORDER, "minimum_genes": 3, "outcome_loaded": False, **settings}))
    out = {k: str(tmp_path / k) for k in outputs}
    code = cli.main([command, *[x for k in inputs for x in (f"--{k}", str(paths[k]))], "--config", str(config), *[x for k, v in out.items() for x in (f"--{k}", v)]], spark)
    return code, out


def near(text, value):
    return text == "" if value is None else float(text) == pytest.approx(value, abs=1e-9)


def module(m, *cohorts):
    names = [(CLEAN.get(g, g), x) for g, x in LOADS[m].items() if g != "NA"]
    return [(g, x) for g, x in names if all(g in c for c in cohorts)]


def edges(z, genes):
    return [np.corrcoef(z[a], z[b])[0, 1] for a, b in combinations(genes, 2)]


def component(z, pairs):
    """Loadings turned towards the frozen signed mean, share of variance, correlation with it."""
    x = np.column_stack([z[g] for g, _ in pairs])
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    load, frozen = vectors[:, -1], x @ np.array([-1.0 if w < 0 else 1.0 for _, w in pairs])
    r = np.corrcoef(x @ load, frozen)[0, 1]
    return (load if r >= 0 else -load), values[-1] / values.sum(), abs(r)


def test_preserve(spark, tmp_path, given):
    paths, z = given
    code, out = run(spark, tmp_path, paths, "preserve", ("reference", "external", "weights"), ("structure", "coverage", "manifest"))
    assert code == 0
    rows, covered = read(out["structure"]), read(out["coverage"])
    assert [r["module_label"] for r in rows] == ORDER == [r["module_label"] for r in covered]
    for r, c in zip(rows, covered):
        pairs = module(r["module_label"], z["reference"], z["external"])
        frozen = module(r["module_label"])
        assert (int(c["n_frozen_genes"]), int(c["n_common_genes"]), c["common_genes"]) == (len(frozen), len(pairs), ";".join(g for g, _ in pairs))
        assert c["missing_external_genes"] == ";".join(g for g, _ in frozen if g not in z["external"])
        assert near(c["coverage_fraction"], len(pairs) / len(frozen) if frozen else None)
        names = ("edge_spearman", "loading_spearman", "external_pc1_variance_explained", "pc1_orientation_correlation_with_frozen_score")
        want = (None,) * 4
        if len(pairs) >= 3:
            genes = [g for g, _ in pairs]
            load, share, turned = component(z["external"], pairs)
            want = (spearman(edges(z["reference"], genes), edges(z["external"], genes)), spearman(load, [w for _, w in pairs]), share, turned)
        assert all(near(r[k], v) for k, v in zip(names, want)), r
        assert r["estimable"] == str(len(pairs) >= 3).lower() and r["nonestimable_reason"] == ("" if len(pairs) >= 3 else "fewer_than_3_common_genes")
    m = manifest(out["manifest"])
    assert m["files"]["external"]["external.csv"]["sha256"] == hashlib.sha256(paths["external"].read_bytes()).hexdigest() and m["outputs"]["structure"]["rows"] == 4


def test_infer(spark, tmp_path, given):
    """Each module's two streams are drawn by plain loops; p and q follow from the counts."""
    paths, z = given
    n = 200
    code, out = run(spark, tmp_path, paths, "infer", ("reference", "external", "weights"), ("inference", "manifest"), n_permutations=n, base_seed=7, module_seed_stride=10)
    assert code == 0
    rows, family = read(out["inference"]), {}
    assert [r["module_label"] for r in rows] == ORDER
    for place, m in enumerate(ORDER):
        pairs = module(m, z["reference"], z["external"])
        if len(pairs) < 3:
            continue
        genes, k = [g for g, _ in pairs], len(pairs)
        a, b = (np.corrcoef(np.column_stack([z[c][g] for g in genes]), rowvar=False) for c in ("reference", "external"))
        at = np.triu_indices(k, 1)
        observed, rng = abs(spearman(a[at], b[at])), np.random.default_rng(7 + 10 * place)
        hits = sum(abs(spearman(a[at], b[np.ix_(p, p)][at])) >= observed - 1e-12 for p in (rng.permutation(k) for _ in range(n)))
        family[m, "edge"] = (hits, (hits + 1) / (n + 1))
        load, frozen = component(z["external"], pairs)[0], [w for _, w in pairs]
        observed, rng = abs(spearman(load, frozen)), np.random.default_rng(8 + 10 * place)
        hits = sum(abs(np.corrcoef(rng.permutation(rank(load)), rank(frozen))[0, 1]) >= observed - 1e-12 for _ in range(n))
        family[m, "loading"] = (hits, (hits + 1) / (n + 1))
    ordered, low, q = sorted(family, key=lambda f: family[f][1]), 1.0, {}
    for i in range(len(ordered), 0, -1):
        low = min(low, family[ordered[i - 1]][1] * len(ordered) / i)
        q[ordered[i - 1]] = low
    for r in rows:
        for kind in ("edge", "loading"):
            hits, p = family.get((r["module_label"], kind), (0, None))
            assert int(r[f"{kind}_extreme_count"]) == hits and near(r[f"{kind}_permutation_p"], p) and near(r[f"{kind}_q_bh_8"], q.get((r["module_label"], kind)))
        assert r["direct_permutation_family_size"] == "4" and r["n_permutations"] == str(n)


def test_reliability(spark, tmp_path, given):
    paths, z = given
    n = 60
    code, out = run(spark, tmp_path, paths, "reliability", ("external", "weights"), ("reliability", "loo", "manifest"), split_half_repeats=n, base_seed=42, module_seed_stride=100, split_half_seed_offset=2)
    assert code == 0
    rows, loo = read(out["reliability"]), read(out["loo"])
    assert [r["module_label"] for r in rows] == ORDER
    z, single = z["external"], []
    for place, r in enumerate(rows):
        pairs, seed = module(r["module_label"], z), 42 + 100 * place + 2
        assert int(r["n_common_genes"]) == len(pairs) and int(r["split_half_seed"]) == seed
        signed = np.array([(-1 if w < 0 else 1) * z[g] for g, w in pairs])
        values, left = [], []
        if len(pairs) >= 4:
            rng = np.random.default_rng(seed)
            for _ in range(n):
                p = rng.permutation(len(pairs))
                values.append(np.corrcoef(signed[p[: len(p) // 2]].mean(axis=0), signed[p[len(p) // 2 :]].mean(axis=0))[0, 1])
            left = [np.corrcoef(signed.mean(axis=0), np.delete(signed, i, axis=0).mean(axis=0))[0, 1] for i in range(len(pairs))]
            single += [(r["module_label"], g, len(pairs) - 1, x) for (g, _), x in zip(pairs, left)]
        assert int(r["split_half_valid_repeats"]) == len(values)
        want = (np.median(values), np.quantile(values, 0.05), np.quantile(values, 0.95), min(left), np.median(left)) if values else (None,) * 5
        assert all(near(r[k], v) for k, v in zip(("split_half_median", "split_half_q05", "split_half_q95", "minimum_gene_loo_correlation", "median_gene_loo_correlation"), want)), r
    assert len(loo) == len(single)
    for r, (m, g, left, x) in zip(loo, single):
        assert (r["module_label"], r["left_out_gene"], int(r["n_genes_remaining"])) == (m, g, left) and near(r["correlation_with_full_score"], x)


def test_runs_that_must_not_start(spark, tmp_path, given, capsys):
    paths, _ = given
    inputs, outputs = ("external", "weights"), ("reliability", "loo", "manifest")
    fine = {"split_half_repeats": 5, "base_seed": 42, "module_seed_stride": 100, "split_half_seed_offset": 2}
    for change, said in (({"outcome_loaded": True}, "outcome_loaded"), ({"module_order": ["A", "Q"]}, "Q"), ({"module_order": ["A", "A"]}, "twice"), ({"split_half_repeats": 0}, "repeats")):
        assert run(spark, tmp_path, paths, "reliability", inputs, outputs, **{**fine, **change})[0] == 2
        assert said in capsys.readouterr().err
    del fine["base_seed"]
    assert run(spark, tmp_path, paths, "reliability", inputs, outputs, **fine)[0] == 2


def test_streams_made_in_tasks_equal_those_of_the_driver(spark):
    sizes, seeds = {"a": 5, "b": 1, "c": 8}, {"a": 3, "b": 4, "c": 5}
    want = sorted(map(tuple, resampling.permutation_schedule(spark, sizes, seeds, 40).collect()))
    frame = spark.createDataFrame([(k, n, seeds[k]) for k, n in sizes.items()] + [("none", 0, 1)], "module_label string, n int, seed long")
    assert sorted(map(tuple, resampling.permutation_streams(frame, 40, cells=16).collect())) == want


def test_seeds_follow_places(spark):
    got = inference.seeded(spark.createDataFrame([("m", 3)], "module_label string, position int"), 42, 100).first()
    assert (got["edge_seed"], got["loading_seed"], got["split_half_seed"]) == (342, 343, 344)
