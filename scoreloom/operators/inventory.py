"""Typed comparison of stored and new tables, hash gates, and inventories of files and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.verify import close

KINDS = ("exact", "close", "text", "list")


def typed_comparison(expected: DataFrame, observed: DataFrame, keys: list[str], kinds: dict[str, str], absolute: float = 1e-10, relative: float = 1e-8) -> DataFrame:
    """One row per column of `kinds`: rows on one side only, mismatches, largest difference, passed.

    exact: equal, missing equals missing; close: within absolute + relative * |expected|; text: missing equals
    ''; list: the same ;-separated items in the same order, blanks aside.
    """
    if set(kinds.values()) - set(KINDS):
        raise ValueError(f"kinds must be of {KINDS}")
    e = expected.select(*keys, *(F.col(c).alias(f"_e_{c}") for c in kinds), F.lit(True).alias("_e"))
    o = observed.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in kinds), F.lit(True).alias("_o"))
    both = e.join(o, keys, "full_outer")
    here = F.col("_e").isNotNull() & F.col("_o").isNotNull()

    def items(x: Column) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(x.cast("string"), F.lit("")), ";"), lambda x: F.trim(x)), lambda i: i != "")

    def same(column: str, kind: str) -> Column:
        a, b = F.col(f"_e_{column}"), F.col(f"_o_{column}")
        if kind == "close":
            return close(b.cast("double"), a.cast("double"), absolute, relative)
        if kind == "text":
            return F.coalesce(a.cast("string"), F.lit("")) == F.coalesce(b.cast("string"), F.lit(""))
        return items(a) == items(b) if kind == "list" else a.eqNullSafe(b)

    out = []
    for c, kind in kinds.items():
        gap = F.max(F.abs(F.col(f"_e_{c}").cast("double") - F.col(f"_o_{c}").cast("double"))) if kind == "close" else F.lit(None).cast("double")
        out.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.count(F.when(~here, 1)).alias("n_one_sided"), F.count(F.when(here & ~same(c, kind), 1)).alias("n_mismatches"), gap.alias("largest_difference")))
    rows = both.agg(*[s.alias(f"s{i}") for i, s in enumerate(out)]).select(F.explode(F.array(*[f"s{i}" for i in range(len(out))])).alias("s")).select("s.*")
    return rows.withColumn("passed", (F.col("n_one_sided") == 0) & (F.col("n_mismatches") == 0))


def hash_gate(records: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded hashes against content hashes as they are and with CRLF ends: name, form that matched, passed.

    `records`: name, sha256; `found`: name, sha256_plain, sha256_crlf. A record without content doesn't pass.
    """
    both = records.join(found, "name", "left")
    form = F.when(F.col("sha256") == F.col("sha256_plain"), "as_is").when(F.col("sha256") == F.col("sha256_crlf"), "crlf").when(F.col("sha256_plain").isNull(), "absent").otherwise("none")
    return both.select("name", form.alias("form"), form.isin("as_is", "crlf").alias("passed"))


def table_probe(df: DataFrame) -> DataFrame:
    """One row: columns in order, their number, rows, and an order-free digest of the rows."""
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), digest.cast("string").alias("digest")).withColumns({"columns": F.lit(";".join(df.columns)), "n_columns": F.lit(len(df.columns)).cast("bigint")})


def porcelain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of a version-control status listing: two status letters, path, earlier path of a rename, class."""
    lines = df.select(id_col, F.posexplode(F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n?", "\n"), "\n")).alias("line_no", "line")).filter(F.length("line") >= 4)
    a, b, path = F.substring("line", 1, 1), F.substring("line", 2, 1), F.substring("line", 4, 1 << 20)
    at = F.instr(path, " -> ")
    moved = at > 0
    kind = F.when((a == "?") & (b == "?"), "untracked")
    for letter, name in (("D", "deleted"), ("R", "renamed"), ("A", "added"), ("M", "modified")):
        kind = kind.when((a == letter) | (b == letter), name)
    return lines.select(id_col, "line_no", a.alias("index_status"), b.alias("worktree_status"), F.when(moved, path.substr(at + 4, F.length(path))).otherwise(path).alias("path"), F.when(moved, path.substr(F.lit(1), at - 1)).otherwise("").alias("original_path"), kind.otherwise("other").alias("status"))


def version_agreement(scripts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Versions that a script declares and that its manifest records: agree, differ or one is missing.

    `scripts`, `manifests`: name, version (several rows per name are joined as a sorted list).
    """
    def joined(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("version")), ";").alias(out))

    both = joined(scripts, "script_version").join(joined(manifests, "manifest_version"), "name", "full_outer")
    state = F.when(F.col("script_version").isNull(), "manifest_only").when(F.col("manifest_version").isNull(), "script_only").when(F.col("script_version") == F.col("manifest_version"), "agree").otherwise("differ")
    return both.withColumn("state", state)


def variability_audit(expr: DataFrame, bins: int = 10) -> DataFrame:
    """Quantile bins of genes by the variance of raw values and of within-cohort z values, and how they agree.

    z has unit variance, so its bins say nothing beyond rounding: the audit shows by how much a panel that is
    matched on the wrong basis differs. One row per cohort.
    """
    from pyspark.sql import Window as W

    from scoreloom.functions.stats import floor_bins, percent_rank_average, z_score

    part = W.partitionBy("cohort", "gene")
    z = expr.withColumn("z", z_score(F.col("value"), part))
    v = z.groupBy("cohort", "gene").agg(F.var_samp("value").alias("raw"), F.round(F.var_samp("z"), 9).alias("scaled"))
    v = v.withColumns({"raw_bin": floor_bins(percent_rank_average("raw", "cohort"), bins), "scaled_bin": floor_bins(percent_rank_average("scaled", "cohort"), bins)})
    return v.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_genes"), F.avg((F.col("raw_bin") == F.col("scaled_bin")).cast("double")).alias("agreement"), F.count_distinct("raw_bin").alias("n_raw_bins"), F.count_distinct("scaled_bin").alias("n_scaled_bins"), F.min("raw").alias("raw_minimum"), F.max("raw").alias("raw_maximum"), F.median("raw").alias("raw_median"))
