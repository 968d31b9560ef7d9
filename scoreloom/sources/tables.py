"""Readers of the audit's files: wide matrices, weights, configs, tolerances, registries, cell matrices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.stats import finite
from scoreloom.schemas import require_columns


def wide_expression(spark: SparkSession, path: str, cohort: str, sep: str = ",") -> DataFrame:
    """Samples x genes text with ids in the first column, as a long table; unreadable values are NULL.

    The order of the header becomes gene_ord, which decides what is kept first.
    """
    frame = spark.read.csv(path, header=True, sep=sep)
    sample, *genes = frame.columns
    order = F.create_map(*[x for i, g in enumerate(genes) for x in (F.lit(g), F.lit(i))])
    long = frame.withColumnRenamed(sample, "sample_id").unpivot("sample_id", genes, "gene", "value")
    return long.select(F.lit(cohort).alias("cohort"), F.col("sample_id").cast("string").alias("sample_id"), "gene", F.get(F.array(*[F.lit(i) for i in range(len(genes))]), F.try_element_at(order, F.col("gene"))).alias("gene_ord"), finite(F.expr("try_cast(value as double)")).alias("value"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, required: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """A text table with a header; missing required columns raise."""
    reader = spark.read.schema(schema) if schema else spark.read
    return require_columns(reader.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True), *required)


def with_file_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Numbers the rows of a small ordered file (read as one partition)."""
    return df.coalesce(1).withColumn(name, F.monotonically_increasing_id().cast("int"))


def run_config(text: str, guarded: bool = True) -> dict:
    """A run's settings; guarded runs must say that no outcome was loaded."""
    config = json.loads(text)
    if guarded and config.get("outcome_loaded", True) is not False:
        raise ValueError("the configuration must state outcome_loaded = false")
    return config


def tolerance_policy(text: str) -> dict:
    """Tolerance classes from YAML; anything but a mapping raises."""
    import yaml

    policy = yaml.safe_load(text)
    if not isinstance(policy, dict):
        raise ValueError("the tolerance policy must be a mapping")
    return policy


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Artifact records of a folder of JSON files."""
    return spark.read.json(path, multiLine=True)


def artifact(records: DataFrame, name: str) -> dict:
    """The one record of an id: none raises KeyError, several RuntimeError."""
    found = records.filter(F.col("id") == name).limit(2).collect()
    if not found:
        raise KeyError(name)
    if len(found) > 1:
        raise RuntimeError(f"several records of {name}")
    return found[0].asDict(recursive=True)


def artifact_path(spark: SparkSession, record: dict, root: str) -> str:
    """The place of a record's file below a root folder; a missing one raises FileNotFoundError."""
    from py4j.protocol import Py4JJavaError

    path = record["path"] if "://" in record["path"] else f"{root.rstrip('/')}/{record['path']}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    except Py4JJavaError:
        there = False
    if not there:
        raise FileNotFoundError(path)
    return path


def first_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that is a column."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {', '.join(candidates)}")


def cell_matrix(spark: SparkSession, path: str, genes: list[str], sep: str = "\t") -> DataFrame:
    """Long cells of chosen genes from a (compressed) genes x cells text; duplicate genes are averaged.

    The header names the cells. Lines of other genes are dropped before they are split.
    """
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith(sep) | F.lower(F.substring_index("value", sep, 1)).isin("gene", "")).limit(1)
    names = header.select(F.split("value", sep).alias("names"))
    rows = lines.withColumn("gene", F.upper(F.trim(F.substring_index("value", sep, 1)))).filter(F.col("gene").isin([g.upper() for g in genes]))
    cells = rows.withColumn("v", F.split("value", sep)).crossJoin(F.broadcast(names))
    checked = cells.withColumn("v", F.when(F.size("v") != F.size("names"), F.raise_error(F.concat(F.lit("row length differs: "), F.col("gene"))).cast("array<string>")).otherwise(F.col("v")))
    # name and value go together, so that no cell carries the list of names
    pairs = F.arrays_zip(F.slice("names", 2, 1 << 30).alias("cell_id"), F.slice("v", 2, 1 << 30).alias("x"))
    long = checked.select("gene", F.explode(pairs).alias("c")).select("gene", "c.cell_id", F.expr("try_cast(c.x as float)").alias("value"))
    return long.groupBy("cell_id", "gene").agg(F.avg("value").alias("value"))


def cases(df: DataFrame, id_col: str = "case_id", follow_ups: str = "follow_ups") -> DataFrame:
    """One row per case from nested records: first status, longest follow-up, death before follow-up.

    `vital_states` are the sorted distinct states, ;-joined. Of records with one id the first stays, by status and time.
    """
    states = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(follow_ups, lambda f: f["vital_status"]), lambda x: x.isNotNull() & (x != "")))), ";")
    status = F.try_element_at(F.filter(F.transform(follow_ups, lambda f: f["vital_status"]), lambda x: x.isNotNull() & (x != "")), F.lit(1))
    longest = F.array_max(F.transform(follow_ups, lambda f: f["days_to_follow_up"]))
    death = F.array_max(F.transform(follow_ups, lambda f: f["days_to_death"]))
    rows = df.select(id_col, status.alias("vital_status"), F.coalesce(death, longest).cast("double").alias("time_days"), (F.lower(status) == "dead").cast("int").alias("event"), states.alias("vital_states"))
    first = F.row_number().over(W.partitionBy(id_col).orderBy(F.col("vital_status").asc_nulls_last(), F.col("time_days").desc_nulls_last()))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def sample_columns(df: DataFrame, pattern: str = r"^CCB\d+|^GSM\d+", least: int = 30, least_numeric: float = 0.95) -> list[str]:
    """Columns that hold samples: named like one, or else almost all numeric; fewer than `least` raises.

    The shares of numeric values are one aggregate over the table.
    """
    import re

    named = [c for c in df.columns if re.search(pattern, c)]
    if len(named) >= least:
        return named
    shares = df.agg(*[F.avg(F.expr(f"try_cast(`{c}` as double)").isNotNull().cast("double")).alias(c) for c in df.columns]).first()
    numeric = [c for c in df.columns if (shares[c] or 0) >= least_numeric]
    if len(numeric) < least:
        raise ValueError("no sample columns found")
    return numeric
