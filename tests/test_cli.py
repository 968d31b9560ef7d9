"""Runs from files to files, against plain loops."""

import csv
import glob
import hashlib
import json
import random
from statistics import mean, stdev

import pytest

from scoreloom import cli


def read(folder):
    rows = []
    for p in sorted(glob.glob(f"{folder}/part-*")):
        with open(p, newline="") as f:
            rows += csv.DictReader(f)
    return rows


def manifest(folder):
    return json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{folder}/part-*"))))


def test_multiplicity(spark, tmp_path):
    given = tmp_path / "p.csv"
    p = ["0.01", "0.2", "", "0.01", "nan", "0.04", "1.0", "0.0"]
    given.write_text("name,primary_p\n" + "".join(f"t{i},{x}\n" for i, x in enumerate(p)))
    out, listed = str(tmp_path / "q"), str(tmp_path / "m")
    assert cli.main(["multiplicity", "--input", str(given), "--output", out, "--manifest", listed], spark) == 0
    rows = read(out)
    known = sorted((float(x), i) for i, x in enumerate(p) if x not in ("", "nan"))
    want, low = {}, 1.0
    for k in range(len(known), 0, -1):
        low = min(low, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = low
    assert [r["name"] for r in rows] == [f"t{i}" for i in range(len(p))]
    for i, r in enumerate(rows):
        assert (r["projectwide_q_12"] == "") if i not in want else float(r["projectwide_q_12"]) == pytest.approx(want[i], abs=1e-12)
        assert r["projectwide_fdr_supported"] == str(i in want and want[i] <= 0.05).lower()
    m = manifest(listed)
    assert m["config"]["summary"] == {"n_rows": 8, "n_finite_pvalues": 6, "n_fdr_supported": sum(q <= 0.05 for q in want.values())}
    assert m["files"]["input"]["p.csv"]["sha256"] == hashlib.sha256(given.read_bytes()).hexdigest()


def test_score(spark, tmp_path):
    r = random.Random(5)
    genes, samples = [f"G{i}" for i in range(6)], [f"s{i}" for i in range(5)]
    cells = {s: [r.gauss(0, 1) for _ in genes] for s in samples}
    loads = {"A": {"G0": 0.5, "G1": -1.0, "G2": 2.0}, "B": {"G3": 1.0, "X1": 1.0, "X2": 1.0, "X3": 1.0}}
    e, w, c = tmp_path / "e.csv", tmp_path / "w.csv", tmp_path / "c.json"
    e.write_text("," + ",".join(genes) + "\n" + "".join(f"{s}," + ",".join(map(repr, v)) + "\n" for s, v in cells.items()))
    w.write_text("module_label,gene,loading\n" + "".join(f"{m},{g},{x}\n" for m, v in loads.items() for g, x in v.items()))
    c.write_text(json.dumps({"cohort": "c1", "module_order": ["B", "A"], "mapping_name": "strict", "minimum_genes": 3, "minimum_fraction": 0.5}))
    out = {k: str(tmp_path / k) for k in ("scores", "coverage", "manifest")}
    command = ["score", "--expression", str(e), "--weights", str(w), "--config", str(c)] + [x for k, v in out.items() for x in (f"--{k}", v)]
    assert cli.main(command, spark) == 0

    def z(v):
        return [(x - mean(v)) / stdev(v) for x in v]

    by_gene = {g: z([cells[s][i] for s in samples]) for i, g in enumerate(genes)}
    a = loads["A"]
    signed = z([mean((1 if x >= 0 else -1) * by_gene[g][i] for g, x in a.items()) for i in range(len(samples))])
    weighted = z([sum(x * by_gene[g][i] for g, x in a.items()) / sum(map(abs, a.values())) for i in range(len(samples))])
    rows = read(out["scores"])
    assert [x["sample_id"] for x in rows] == samples
    for i, x in enumerate(rows):
        assert float(x["A__strict__signed_mean_z"]) == pytest.approx(signed[i], abs=1e-9)
        assert float(x["A__strict__canine_pca_weighted_z"]) == pytest.approx(weighted[i], abs=1e-9)
        assert x["B__strict__signed_mean_z"] == ""
    covered = read(out["coverage"])
    assert [(x["module_label"], x["n_frozen_genes"], x["n_available_genes"], x["missing_genes"], x["estimable"]) for x in covered] == [("B", "4", "1", "X1;X2;X3", "false"), ("A", "3", "3", "", "true")]
    m = manifest(out["manifest"])
    assert m["guardrails"]["outcome_loaded"] is False and m["inputs"]["weights"]["rows"] == 7
    assert m["files"]["config"]["c.json"]["sha256"] == hashlib.sha256(c.read_bytes()).hexdigest()
    assert m["outputs"]["scores"]["rows"] == len(samples)


def test_wrong_input_has_exit_code_two(spark, tmp_path, capsys):
    given = tmp_path / "p.csv"
    given.write_text("name,p\na,0.5\n")
    out = ["--output", str(tmp_path / "q"), "--manifest", str(tmp_path / "m")]
    assert cli.main(["multiplicity", "--input", str(given), *out], spark) == 2
    assert "primary_p" in capsys.readouterr().err
    assert cli.main(["multiplicity", "--input", str(tmp_path / "absent.csv"), *out], spark) == 2
    given.write_text("name,primary_p\na,1.5\n")
    assert cli.main(["multiplicity", "--input", str(given), *out], spark) == 2


def test_verify(spark, tmp_path):
    tables = {"a": "k,x,y\n1,0.5,1\n2,,2\n", "same": "k,x,y\n2,,2\n1,0.50000000001,1\n", "other": "k,x,y\n1,0.6,1\n2,,2\n", "less": "k,x,y\n1,0.5,1\n", "twice": "k,x,y\n1,0.5,1\n1,0.5,1\n2,,2\n"}
    for k, v in tables.items():
        (tmp_path / f"{k}.csv").write_text(v)

    def run(other):
        report = str(tmp_path / f"report_{other}")
        return cli.main(["verify", "--expected", str(tmp_path / "a.csv"), "--observed", str(tmp_path / f"{other}.csv"), "--keys", "k", "--metrics", "x,y", "--report", report], spark), report

    assert [run(k)[0] for k in ("same", "other", "less", "twice")] == [0, 1, 1, 2]
    assert [(r["metric"], r["n_rows"], r["n_mismatches"], r["passed"]) for r in read(run("other")[1])] == [("x", "2", "1", "false"), ("y", "2", "0", "true")]
