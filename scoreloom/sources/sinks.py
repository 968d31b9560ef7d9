"""Writers: result tables, gene set files and run manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result table; CSV carries a header."""
    df.write.mode("overwrite").format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)


def indexed_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """A CSV table whose first column is the index; an index without a name is written as sample_id."""
    index = index or df.columns[0]
    rest = [c for c in df.columns if c != index]
    df.select(F.col(f"`{index}`").alias(index.strip() or "sample_id"), *[F.col(f"`{c}`") for c in rest]).write.mode("overwrite").option("header", "true").csv(path)


def gene_sets(members: DataFrame, path: str, name: str, item: str, description: str = "") -> None:
    """One line per set: name, description, items in order, tab-separated."""
    lines = members.groupBy(name).agg(F.sort_array(F.collect_set(item)).alias("_i")).select(F.concat_ws("\t", F.col(name), F.lit(description), F.concat_ws("\t", "_i")).alias("value"))
    lines.write.mode("overwrite").text(path)


def manifest(config: dict, inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], guardrails: dict[str, bool], files: dict[str, DataFrame] | None = None) -> str:
    """JSON text of a run: its settings, its tables' shapes and order-free digests of their rows, its guardrails, and its files' hashes.

    `files`: tables of `files.file_hashes` by name (a run's inputs or outputs, not a corpus); each file is listed with its size and SHA-256.
    """

    def shape(tables: dict[str, DataFrame]) -> dict:
        out = {}
        for k, v in tables.items():
            row = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*v.columns).cast("decimal(38,0)")).alias("d")).first()
            out[k] = {"rows": row["n"], "columns": v.columns, "digest": str(row["d"])}
        return out

    listed = {k: {r["name"]: {"bytes": r["length"], "sha256": r["sha256"]} for r in v.orderBy("name").collect()} for k, v in (files or {}).items()}
    return json.dumps({"created_utc": datetime.now(timezone.utc).isoformat(), "config": config, "inputs": shape(inputs), "outputs": shape(outputs), "guardrails": guardrails, "files": listed}, indent=2, sort_keys=True)
