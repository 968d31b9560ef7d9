"""Command line: runs from files to files.

    python -m scoreloom.cli multiplicity --input P.csv --output OUT --manifest OUT [--p-column ...]
    python -m scoreloom.cli score --expression E.csv --weights W.csv --config C.json --scores OUT --coverage OUT --manifest OUT
    python -m scoreloom.cli preserve --reference R.csv --external E.csv --weights W.csv --config C.json --structure OUT --coverage OUT --manifest OUT
    python -m scoreloom.cli infer --reference R.csv --external E.csv --weights W.csv --config C.json --inference OUT --manifest OUT
    python -m scoreloom.cli reliability --external E.csv --weights W.csv --config C.json --reliability OUT --loo OUT --manifest OUT
    python -m scoreloom.cli verify --expected A.csv --observed B.csv --keys K,... --metrics M,... --report OUT

Inputs are files or folders of CSV files that Spark reads; outputs are folders that Spark writes (CSV with a header;
the manifest as text). Exit code 0: done; 1: tables that were
verified differ; 2: a wrong argument, input or configuration, named on stderr.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.stats import benjamini_hochberg, finite, significant
from scoreloom.operators import reports, scoring, standardize, verify
from scoreloom.schemas import ScoringRule
from scoreloom.sources import files, sinks, tables


def _manifest(spark: SparkSession, path: str, config: dict, inputs: dict, outputs: dict[str, str], guardrails: dict[str, bool]) -> None:
    """Tables and files of a run; outputs are read back from where they were written."""
    written = {k: spark.read.csv(v, header=True) for k, v in outputs.items()}
    hashes = {k: files.file_hashes(spark, v) for k, v in {**{k: v[0] for k, v in inputs.items()}, **outputs}.items()}
    text = sinks.manifest(config, {k: v[1] for k, v in inputs.items() if v[1] is not None}, written, guardrails, hashes)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _config(spark: SparkSession, path: str, needed: set[str], guarded: bool = True) -> dict:
    """A run's settings; absent ones raise."""
    config = tables.run_config("\n".join(r["value"] for r in spark.read.text(path).collect()), guarded)
    missing = sorted(needed - set(config))
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    return config


def _weights(spark: SparkSession, path: str) -> DataFrame:
    """Weights as they stand in their file, numbered."""
    return tables.with_file_order(tables.csv_table(spark, path, required=("module_label", "gene", "loading")))


def _cohorts(spark: SparkSession, a: argparse.Namespace, config: dict, *names: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame, list[str]]:
    """Cohorts as they stand in their files, weights as they stand and as used, standardised values, and the modules in order."""
    order = [str(m) for m in config["module_order"]]
    if len(set(order)) < len(order):
        raise ValueError("a module is listed twice")
    given = _weights(spark, a.weights)
    weights = reports.preserved_program(given.withColumn("loading", F.expr("try_cast(loading as double)")), order)
    long = {n: tables.wide_expression(spark, getattr(a, n), n) for n in names}
    both = None
    for frame in long.values():
        both = frame if both is None else both.unionByName(frame)
    return long, given, weights, standardize.standardised(standardize.normalised(both, "clean")).persist(), order


def _preservation_manifest(spark: SparkSession, a: argparse.Namespace, config: dict, long: dict[str, DataFrame], given: DataFrame, outputs: dict[str, str]) -> None:
    inputs = {**{n: (getattr(a, n), frame) for n, frame in long.items()}, "weights": (a.weights, given), "config": (a.config, None)}
    _manifest(spark, a.manifest, config, inputs, outputs, {"outcome_loaded": False, "membership_and_loadings_changed": False})


def preserve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Structure and coverage of frozen programs in another cohort; the settings must say that no outcome was loaded."""
    config = _config(spark, a.config, {"module_order", "minimum_genes"})
    long, given, weights, z, order = _cohorts(spark, a, config, "reference", "external")
    structure, coverage = reports.preserved(z, weights, order, int(config["minimum_genes"]))
    sinks.table(structure, a.structure, "csv")
    sinks.table(coverage, a.coverage, "csv")
    z.unpersist()
    _preservation_manifest(spark, a, config, long, given, {"structure": a.structure, "coverage": a.coverage})


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    """Permutation tests of the same runs, with q values over both tests of all modules."""
    config = _config(spark, a.config, {"module_order", "minimum_genes", "n_permutations"})
    long, given, weights, z, order = _cohorts(spark, a, config, "reference", "external")
    table = reports.inferred(z, weights, order, int(config["minimum_genes"]), int(config["n_permutations"]), int(config.get("base_seed", 42)), int(config.get("module_seed_stride", 100)))
    sinks.table(table, a.inference, "csv")
    z.unpersist()
    _preservation_manifest(spark, a, config, long, given, {"inference": a.inference})


def reliability(spark: SparkSession, a: argparse.Namespace) -> None:
    """Split halves and leave-one-out of frozen programs in one cohort, by the seeds of the settings."""
    config = _config(spark, a.config, {"module_order", "minimum_genes", "split_half_repeats", "base_seed", "module_seed_stride", "split_half_seed_offset"})
    long, given, weights, z, order = _cohorts(spark, a, config, "external")
    table, single = reports.reliability(z, weights, order, *(int(config[k]) for k in ("minimum_genes", "split_half_repeats", "base_seed", "module_seed_stride", "split_half_seed_offset")))
    sinks.table(table, a.reliability, "csv")
    sinks.table(single, a.loo, "csv")
    z.unpersist()
    _preservation_manifest(spark, a, config, long, given, {"reliability": a.reliability, "gene_leave_one_out": a.loo})


def multiplicity(spark: SparkSession, a: argparse.Namespace) -> None:
    """Adds q values and whether they are supported to a table of p values; its rows are one family."""
    given = tables.with_file_order(tables.csv_table(spark, a.input, required=(a.p_column,)), "_ord")
    columns = [c for c in given.columns if c not in ("_ord", a.q_column, a.support_column)]
    p = F.expr(f"try_cast(`{a.p_column}` as double)")
    tested = benjamini_hochberg(given.withColumn("_value", p), "_value", order="_ord", q="_q")
    result = tested.withColumn("_s", F.coalesce(significant("_q", a.alpha), F.lit(False))).orderBy("_ord")
    sinks.table(result.select(*[F.col(f"`{c}`") for c in columns], F.col("_q").alias(a.q_column), F.col("_s").alias(a.support_column)), a.output, "csv")
    back = spark.read.csv(a.output, header=True, inferSchema=True)
    n = back.agg(F.count(F.lit(1)).alias("n_rows"), F.count(finite(p)).alias("n_finite_pvalues"), F.count_if(F.col(f"`{a.support_column}`")).alias("n_fdr_supported")).first().asDict()
    parameters = {"p_column": a.p_column, "q_column": a.q_column, "support_column": a.support_column, "alpha": a.alpha}
    _manifest(spark, a.manifest, {"parameters": parameters, "summary": n}, {"input": (a.input, given.drop("_ord"))}, {"output": a.output}, {})


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Frozen program scores of one cohort, one row per sample by sample id, and their coverage in module order."""
    config = _config(spark, a.config, {"cohort", "module_order", "mapping_name", "minimum_genes", "minimum_fraction"}, guarded=False)
    rule = ScoringRule(str(config["mapping_name"]), int(config["minimum_genes"]), float(config["minimum_fraction"]))
    order = [str(m) for m in config["module_order"]]
    given = _weights(spark, a.weights)
    weights = scoring.frozen_program(given.withColumn("loading", F.expr("try_cast(loading as double)")))
    for m in order:
        scoring.module(weights, m)
    weights = weights.filter(F.col("module_label").isin(order))
    long = tables.wide_expression(spark, a.expression, str(config["cohort"]))
    expr = standardize.normalised(long)
    z = standardize.standardised(expr)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("module_label"))
    coverage = scoring.coverage(expr, z, weights, rule).withColumn("mapping", F.lit(rule.mapping_name)).orderBy(place)
    wide = scoring.wide_scores(scoring.scores(expr, z, weights, rule), rule.mapping_name, order)
    # samples without any score stay, with empty cells
    rows = expr.select("sample_id").distinct().join(wide.drop("cohort"), "sample_id", "left").orderBy("sample_id")
    sinks.indexed_csv(rows, a.scores, "sample_id")
    sinks.table(coverage, a.coverage, "csv")
    _manifest(spark, a.manifest, config, {"expression": (a.expression, long), "weights": (a.weights, given), "config": (a.config, None)}, {"scores": a.scores, "coverage": a.coverage}, {"outcome_loaded": False, "membership_and_loadings_changed": False})


def verified(spark: SparkSession, a: argparse.Namespace) -> int:
    """Compares numbers of two tables key by key; the report has a row per metric. Repeated keys raise."""
    keys, metrics = a.keys.split(","), a.metrics.split(",")
    sides = []
    for path in (a.expected, a.observed):
        given = tables.csv_table(spark, path, required=(*keys, *metrics))
        repeated = verify.unique_keys(given, keys).first()
        if repeated:
            raise ValueError(f"{path}: key {[repeated[k] for k in keys]} occurs {repeated['n']} times")
        sides.append(given.select(*keys, *[finite(F.expr(f"try_cast(`{m}` as double)")).alias(m) for m in metrics]))
    report = verify.verdict(verify.compared(*sides, keys, metrics, a.absolute, a.relative))
    sinks.table(report.orderBy("metric"), a.report, "csv")
    passed = spark.read.csv(a.report, header=True).agg(F.count_if(F.col("passed") != "true").alias("n")).first()["n"] == 0
    return 0 if passed else 1


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="scoreloom")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("multiplicity", help=multiplicity.__doc__)
    for name in ("--input", "--output", "--manifest"):
        one.add_argument(name, required=True)
    one.add_argument("--p-column", default="primary_p")
    one.add_argument("--q-column", default="projectwide_q_12")
    one.add_argument("--support-column", default="projectwide_fdr_supported")
    one.add_argument("--alpha", type=float, default=0.05)
    one.set_defaults(run=multiplicity)
    two = commands.add_parser("score", help=score.__doc__)
    for name in ("--expression", "--weights", "--config", "--scores", "--coverage", "--manifest"):
        two.add_argument(name, required=True)
    two.set_defaults(run=score)
    for run, names in ((preserve, "reference external weights config structure coverage manifest"), (infer, "reference external weights config inference manifest"), (reliability, "external weights config reliability loo manifest")):
        more = commands.add_parser(run.__name__, help=run.__doc__)
        for name in names.split():
            more.add_argument(f"--{name}", required=True)
        more.set_defaults(run=run)
    three = commands.add_parser("verify", help=verified.__doc__)
    for name in ("--expected", "--observed", "--keys", "--metrics", "--report"):
        three.add_argument(name, required=True)
    three.add_argument("--absolute", type=float, default=1e-10)
    three.add_argument("--relative", type=float, default=1e-8)
    three.set_defaults(run=verified)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("scoreloom").getOrCreate()
    try:
        return a.run(spark, a) or 0
    except (ValueError, KeyError, OSError, PySparkException) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
