"""Every query with SQL equals it on the smallest tables; the others run."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def audit_names():
    from scoreloom.plans import registry

    return list(registry.QUERIES)


def rows(frame):
    import pandas as pd

    columns = sorted(frame.columns)
    text = lambda v: "" if pd.isna(v) else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[columns].values.tolist())


@pytest.mark.parametrize("name", audit_names())
def test_query(spark, name):
    import duckdb

    from scoreloom.plans import catalogue

    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sources_and_sinks(spark, tmp_path):
    from scoreloom.sources import sinks, tables

    (tmp_path / "x.csv").write_text("id,A,B\ns1,1,NA\ns2,2,4\n")
    got = {(r["sample_id"], r["gene"], r["gene_ord"]): r["value"] for r in tables.wide_expression(spark, f"file://{tmp_path}/x.csv", "c").collect()}
    assert got == {("s1", "A", 0): 1.0, ("s1", "B", 1): None, ("s2", "A", 0): 2.0, ("s2", "B", 1): 4.0}
    with pytest.raises(ValueError):
        tables.run_config("{}")
    assert tables.run_config('{"outcome_loaded": false}') == {"outcome_loaded": False}
    with pytest.raises(ValueError):
        tables.tolerance_policy("[1]")
    members = spark.createDataFrame([("m", "B"), ("m", "A")], "module string, gene string")
    sinks.gene_sets(members, f"file://{tmp_path}/sets", "module", "gene", "d")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/sets").collect()] == ["m\td\tA\tB"]
    (tmp_path / "cells.tsv").write_text("gene\tc1\tc2\nA\t1\t2\nA\t3\t4\nB\t9\t9\n")
    cells = {(r["cell_id"], r["gene"]): r["value"] for r in tables.cell_matrix(spark, f"file://{tmp_path}/cells.tsv", ["a"]).collect()}
    assert cells == {("c1", "A"): 2.0, ("c2", "A"): 3.0}


def test_more_sources_and_sinks(spark, tmp_path):
    import json

    from scoreloom.sources import sinks, tables

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"x")
    df = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "` ` string, x double")
    sinks.indexed_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).columns == ["sample_id", "x"]
    a, b = (json.loads(sinks.manifest({}, {"t": d}, {}, {}))["inputs"]["t"] for d in (df, df.orderBy("x", ascending=False)))
    assert a == b and a["rows"] == 2
    assert tables.artifact_path(spark, {"path": "in/a.bin"}, f"file://{tmp_path}").endswith("in/a.bin")
    with pytest.raises(FileNotFoundError):
        tables.artifact_path(spark, {"path": "in/none"}, f"file://{tmp_path}")
    nested = spark.createDataFrame([("c", [("Dead", 5, 3), ("Alive", 9, None)]), ("c", [(None, 1, None)]), ("d", [])], "case_id string, follow_ups array<struct<vital_status:string,days_to_follow_up:int,days_to_death:int>>")
    got = {r["case_id"]: (r["vital_status"], r["time_days"], r["event"], r["vital_states"]) for r in tables.cases(nested).collect()}
    assert got == {"c": ("Dead", 3.0, 1, "Alive;Dead"), "d": (None, None, None, "")}


def test_alignment_errors(spark):
    from scoreloom.operators import alignment, inventory

    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    assert alignment.aligned(a, a, ["k"]).count() == 2
    with pytest.raises(Exception, match="align"):
        alignment.aligned(a, a.filter("k = 'x'"), ["k"]).collect()
    with pytest.raises(Exception, match="align"):
        alignment.aligned(a, a.unionByName(a), ["k"]).collect()
    with pytest.raises(ValueError):
        alignment.aligned(a, a.withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(Exception, match="missing or repeated"):
        alignment.fixed_order(a, "k", ["y", "z"]).collect()
    found = alignment.cardinality(spark.createDataFrame([("l1", "d1"), ("l2", "d1"), ("l3", "d2")], "lib string, donor string"), "lib", "donor")
    assert alignment.checked_cardinality(found, 3, 2, "1/2").count() == 1
    with pytest.raises(Exception, match="cardinality"):
        alignment.checked_cardinality(found, 3, 2, "2/2").collect()
    with pytest.raises(ValueError):
        inventory.typed_comparison(a, a, ["k"], {"v": "near"})


def test_inference_table(spark):
    """Fifteen columns and the joint family, with p values from the counts."""
    from scoreloom.plans import audits

    rows = audits.inference_table(spark, SF).collect()
    assert len(rows[0]) == 16 and {r["direct_permutation_family_size"] for r in rows} == {2 * len(rows)}
    for r in rows:
        for k in ("edge", "loading"):
            assert abs(r[f"{k}_permutation_p"] - (r[f"{k}_extreme_count"] + 1) / 5001) < 1e-9 and r[f"{k}_q_bh_8"] >= r[f"{k}_permutation_p"] - 1e-9


def test_files_of_any_size(spark, tmp_path):
    """Empty files, equal names in subfolders, and a sparse file beyond 2 GiB."""
    import hashlib
    import json

    from scoreloom.sources import files, sinks

    (tmp_path / "in" / "sub").mkdir(parents=True)
    content = {"a.bin": b"\x00\xff\r\n", "sub/a.bin": b"y" * (files.RANGE + 1), "empty": b""}
    for name, data in content.items():
        (tmp_path / "in" / name).write_bytes(data)
    want = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in content.items()}
    copied = files.verified_copy(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert {r["name"]: (r["length"], r["sha256"]) for r in copied} == want and all(r["agree"] for r in copied)
    assert all((tmp_path / "out" / name).read_bytes() == data for name, data in content.items())
    listed = json.loads(sinks.manifest({}, {}, {}, {}, {"in": files.file_hashes(spark, f"file://{tmp_path}/in")}))["files"]["in"]
    assert {k: (v["bytes"], v["sha256"]) for k, v in listed.items()} == want
    (tmp_path / "large").mkdir()
    with open(tmp_path / "large" / "sparse", "wb") as f:
        f.truncate((2 << 30) + 5)
    with open(tmp_path / "large" / "sparse", "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    assert tuple(files.file_hashes(spark, f"file://{tmp_path}/large").first()) == ("sparse", (2 << 30) + 5, digest)
    assert files.file_hashes(spark, f"file://{tmp_path}/out/sub").count() == 1


def test_orientation_in_two_stages(spark):
    """Every branch: disease-free endpoint by coefficient or ratio, overall survival, none; smallest p first."""
    import math

    from scoreloom.operators import stability

    rows = [
        ("A", "DFI", -0.5, None, 0.04), ("A", "DFI", 0.9, None, 0.2), ("A", "OS", 0.7, None, 0.01), ("B", "dfi", None, 0.5, 0.1), ("C", "DFI", None, -1.0, 0.1), ("C", "OS", 0.3, None, None),
        ("D", "DFI", float("nan"), float("inf"), 0.1), ("D", "OS", None, 0.2, 0.5), ("E", "PFS", -1.0, None, 0.1), ("F", "OS", None, None, 0.1),
    ]
    df = spark.createDataFrame(rows, "module_label string, endpoint string, coef double, hazard_ratio double, p_value double")
    got = {r["module_label"]: (r["endpoint"], round(r["coefficient"], 6), r["multiplier"]) for r in stability.risk_multipliers(df).collect()}
    assert got == {"A": ("DFI", -0.5, -1.0), "B": ("DFI", round(math.log(0.5), 6), -1.0), "C": ("OS", 0.3, 1.0), "D": ("OS", round(math.log(0.2), 6), -1.0)}
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.normal(size=12)
    genes = [("c", m, f"s{i}", f"g{j}", j, 1.0, float(base[i] + rng.normal() / 5)) for m in "ABCE" for i in range(12) for j in range(4)]
    z = spark.createDataFrame(genes, "cohort string, module_label string, sample_id string, gene string, ord int, loading double, z double")
    scores = spark.createDataFrame([(m, f"s{i}", float(s * base[i])) for m, s in (("A", 1), ("B", -1), ("C", -1)) for i in range(12)], "module_label string, sample_id string, score double")
    out = {}
    for r in stability.oriented_weights(z, "c", scores, df).collect():
        out.setdefault(r["module_label"], set()).add((np.sign(r["raw_loading"]), np.sign(r["risk_loading"]), r["endpoint"]))
    assert out == {"A": {(1, -1, "DFI")}, "B": {(-1, 1, "DFI")}, "C": {(-1, -1, "OS")}, "E": {(1, 1, None)}}
    without = stability.component_scores(z, "c", without=spark.createDataFrame([("g0",), ("g1",), ("g2",)], "gene string"))
    assert without.filter("score is not null").count() == 0 and without.count() == 48
