"""Verification against stored results, and provenance of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a one-to-one comparison needs none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """|a - b| <= absolute + relative * |b|; missing on both sides is a match."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= absolute + relative * F.abs(b))


def compared(expected: DataFrame, observed: DataFrame, keys: list[str], metrics: list[str], absolute: float = 1e-10, relative: float = 1e-8) -> DataFrame:
    """Full outer comparison, one row per key and metric: side, expected, observed, matches."""
    e = expected.unpivot(keys, metrics, "metric", "expected").withColumn("_e", F.lit(True))
    o = observed.unpivot(keys, metrics, "metric", "observed").withColumn("_o", F.lit(True))
    both = e.join(o, [*keys, "metric"], "full_outer")
    side = F.when(F.col("_e").isNull(), "observed_only").when(F.col("_o").isNull(), "expected_only").otherwise("both")
    return both.withColumns({"side": side, "matches": (side == "both") & close(F.col("observed"), F.col("expected"), absolute, relative)}).drop("_e", "_o")


def verdict(comparison: DataFrame) -> DataFrame:
    """Per metric: rows, mismatches, keys on one side only, largest difference, passed."""
    return comparison.groupBy("metric").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~F.col("matches"), 1)).alias("n_mismatches"), F.count(F.when(F.col("side") != "both", 1)).alias("n_one_sided"), F.max(F.abs(F.col("observed") - F.col("expected"))).alias("max_abs_difference")).withColumn("passed", F.col("n_mismatches") == 0)


def duplicate_content(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hashes shared by several ids: how many, and the smallest and largest of them."""
    return df.filter(F.col(text_col).isNotNull()).groupBy(F.sha2(text_col, 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).filter("n > 1")


def hash_forms(df: DataFrame, text_col: str) -> DataFrame:
    """Adds the content's hash as it is and with CRLF line ends, the two forms a record may hold."""
    unix = F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n"))
    return df.withColumns({"sha256_plain": F.sha2(F.col(text_col), 256), "sha256_crlf": F.sha2(F.replace(unix, F.lit("\n"), F.lit("\r\n")), 256)})


def count_of_p(p: Column, n: int) -> Column:
    """The count behind p = (count + 1) / (n + 1); NULL where p is not of that form."""
    raw = p * (n + 1) - 1
    return F.when(F.abs(raw - F.rint(raw)) <= 1e-8, F.rint(raw).cast("bigint"))


def axes(df: DataFrame, id_col: str, text_col: str, keywords: DataFrame) -> DataFrame:
    """Weighted keyword axes of texts: those that reach max(2, min(4, best)), best first.

    `keywords` (axis, keyword, weight) is a fixed small table; each text is read once.
    """
    table = [(r["axis"], r["keyword"], float(r["weight"])) for r in keywords.collect()]
    names = sorted({t[0] for t in table})
    low = F.lower(F.coalesce(text_col, F.lit("")))
    sums = [F.struct((-sum((F.when(low.contains(k), F.lit(w)).otherwise(0.0) for a, k, w in table if a == n), F.lit(0.0))).alias("s"), F.lit(n).alias("axis")) for n in names]
    scored = df.select(id_col, F.sort_array(F.array(*sums)).alias("_a"))
    best = -F.get(F.col("_a"), F.lit(0))["s"]
    need = F.greatest(F.lit(2.0), F.least(F.lit(4.0), best))
    return scored.select(id_col, F.array_join(F.transform(F.filter("_a", lambda x: -x["s"] >= need), lambda x: x["axis"]), ";").alias("axes"), best.alias("best_score"))


def line_signals(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """Lines that match each labelled pattern: id, label, number of lines."""
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n", -1)

    def matching(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda line: line.rlike(pattern)))

    counts = F.array(*[F.struct(F.lit(k).alias("label"), matching(v).alias("n_lines")) for k, v in patterns.items()])
    return df.select(id_col, F.explode(counts).alias("s")).select(id_col, "s.label", F.col("s.n_lines").cast("bigint").alias("n_lines")).filter("n_lines > 0")


def extracted(df: DataFrame, id_col: str, text_col: str, pattern: str, group: int = 0) -> DataFrame:
    """Sorted distinct matches of a pattern, ;-joined."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(pattern), F.lit(group))))
    return df.select(id_col, F.size(found).cast("bigint").alias("n_found"), F.array_join(found, ";").alias("found"))


def conflicts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with several names."""
    return df.groupBy(key).agg(F.count_distinct(name).alias("n"), F.min(name).alias("first_name")).filter("n > 1")


def decided(df: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Decisions (key, status, note) merged in; a note is appended once."""
    d = decisions.select(F.col(key).alias("_k"), F.col("status").alias("_s"), F.col("note").alias("_n"))
    both = df.join(d, F.col(key) == F.col("_k"), "left")
    note = F.when(F.col("_n").isNull() | F.coalesce("note", F.lit("")).contains(F.col("_n")), F.col("note")).when(F.coalesce("note", F.lit("")) == "", F.col("_n")).otherwise(F.concat_ws("; ", "note", "_n"))
    return both.withColumns({"status": F.coalesce("_s", "status"), "note": note}).drop("_k", "_s", "_n")
