"""Alignment of tables: key families, fixed orders, identifier mapping, set algebra and leading rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_family(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of both sides, keys of one side only, repeated keys, and whether the families agree."""
    na, nb = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    both = na.join(nb, keys, "full_outer")
    found = both.agg(F.count("_na").alias("n_a"), F.count("_nb").alias("n_b"), F.count(F.when(F.col("_nb").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_na").isNull(), 1)).alias("only_b"), F.count(F.when((F.col("_na") > 1) | (F.col("_nb") > 1), 1)).alias("n_repeated"))
    return found.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("n_repeated") == 0))


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables side by side; fails at run time where a key is on one side only or repeated.

    Columns other than the keys must have the same names in the same order; they come out as `a_x`, `b_x`.
    """
    names = [c for c in a.columns if c not in keys]
    if names != [c for c in b.columns if c not in keys]:
        raise ValueError("columns differ or stand in another order")
    count = F.count(F.lit(1)).over(W.partitionBy(*keys))
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in names), F.lit(True).alias("_a"))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in names), F.lit(True).alias("_b"))
    both = left.join(right, keys, "full_outer").withColumn("_n", count)
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_n") > 1)
    checked = both.withColumn(keys[0], F.when(bad, F.raise_error(F.concat(F.lit("keys do not align: "), F.col(keys[0]).cast("string"))).cast(both.schema[keys[0]].dataType)).otherwise(F.col(keys[0])))
    return checked.drop("_a", "_b", "_n")


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct non-null keys with the rank of their first appearance, from 0."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return firsts.select(key, (F.row_number().over(W.orderBy("_first", key)) - 1).alias("position"))


def fixed_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of the listed keys with their place in the list; a key that is missing or repeated raises."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate(order)], f"{key} string, position int")
    n = F.count("_here").over(W.partitionBy(key))
    both = F.broadcast(wanted).join(df.withColumn("_here", F.lit(True)), key, "left").withColumn("_n", n)
    position = F.when(F.col("_n") != 1, F.raise_error(F.concat(F.lit("missing or repeated: "), F.col(key))).cast("int")).otherwise(F.col("position"))
    return both.withColumn("position", position).drop("_here", "_n")


def common(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table holds."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), tables[1:], tables[0].select(key).distinct())


def side_by_side(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of score tables on one key; a table's columns are prefixed by its name."""
    named = [t.select(key, *(F.col(c).alias(f"{n}__{c}") for c in t.columns if c != key)) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def mapped_weights(weights: DataFrame, orthologs: DataFrame, gene: str = "gene") -> DataFrame:
    """Weights mapped one to many; a gene without a mapping keeps a row with an empty symbol.

    `orthologs`: dog_symbol, human_gene_symbol, ortholog_qc_status. Adds the flags of strict and broad
    mappings, and the weight normalised within the module.
    """
    o = orthologs.select(F.upper(F.trim("dog_symbol")).alias("_dog"), F.upper(F.trim(F.coalesce("human_gene_symbol", F.lit("")))).alias("human_gene_symbol"), "ortholog_qc_status")
    joined = weights.join(o, F.upper(F.trim(gene)) == F.col("_dog"), "left").drop("_dog")
    status = F.coalesce("ortholog_qc_status", F.lit("not_found_in_ortholog_table"))
    symbol = F.coalesce("human_gene_symbol", F.lit(""))
    joined = joined.withColumns({"human_gene_symbol": symbol, "ortholog_qc_status": status})
    mapped = F.col("human_gene_symbol") != ""
    total = F.sum(F.abs("loading")).over(W.partitionBy("module_label"))
    return joined.withColumns({
        "absolute_loading": F.abs("loading"),
        "is_strict_mapping": mapped & (F.col("ortholog_qc_status") == "strict_symbol_concordant_one_to_one"),
        "is_broad_mapping": mapped & ~F.col("ortholog_qc_status").isin("not_transferable_or_unmapped", "not_found_in_ortholog_table"),
        "human_symbol_duplicate_count": F.when(mapped, F.count(F.lit(1)).over(W.partitionBy("module_label", "human_gene_symbol"))).otherwise(F.lit(0)),
        "normalized_weight": F.col("loading") / F.nullif(total, F.lit(0.0)),
    })


def identifier_overlap(frozen: DataFrame, external: DataFrame, minimum: int = 3) -> DataFrame:
    """Shared identifiers of each pair of a frozen and an external column under each scheme.

    `frozen`: column_name, scheme, module_label, id; `external`: column_name, scheme, id. Both hold a row per
    value; the pairs of column names are few, the identifiers meet by an equi-join and never all by all.
    """
    f = frozen.filter("id != ''").select(F.col("column_name").alias("frozen_column"), "scheme", "module_label", "id").distinct()
    e = external.filter("id != ''").select(F.col("column_name").alias("external_column"), "scheme", "id").distinct()
    nf = f.groupBy("frozen_column", "scheme").agg(F.count_distinct("id").alias("n_frozen"))
    ne = e.groupBy("external_column", "scheme").agg(F.count(F.lit(1)).alias("n_external"))
    shared = f.join(e, ["scheme", "id"])
    per = shared.groupBy("frozen_column", "external_column", "scheme", "module_label").agg(F.count(F.lit(1)).alias("k"))
    modules = per.groupBy("frozen_column", "external_column", "scheme").agg(F.count(F.when(F.col("k") >= minimum, 1)).alias("n_modules"))
    unique = shared.groupBy("frozen_column", "external_column", "scheme").agg(F.count_distinct("id").alias("n_overlap"))
    pairs = nf.join(ne, "scheme")
    out = pairs.join(unique, ["frozen_column", "external_column", "scheme"], "left").join(modules, ["frozen_column", "external_column", "scheme"], "left")
    return out.fillna(0, ["n_overlap", "n_modules"])


def best_identifier_pair(overlaps: DataFrame, preference: Column) -> DataFrame:
    """The pair with most modules, then most shared identifiers, then the preferred scheme, then names."""
    order = W.orderBy(F.desc("n_modules"), F.desc("n_overlap"), preference.desc(), "frozen_column", "external_column", "scheme")
    return overlaps.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def remapped(expr: DataFrame, mapping: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Expression under new gene names: the first mapping of a gene, else `fallback` of its name, else it goes.

    `expr`: cohort, sample_id, gene, gene_ord, value; `mapping`: gene, new_gene, ord. Of genes that get one name the first stays.
    """
    first = mapping.filter("new_gene != ''").groupBy("gene").agg(F.min(F.struct("ord", "new_gene"))["new_gene"].alias("new_gene"))
    named = expr.join(F.broadcast(first), "gene", "left")
    name = F.coalesce("new_gene", fallback) if fallback is not None else F.col("new_gene")
    named = named.withColumn("gene", name).filter(F.col("gene").isNotNull() & (F.col("gene") != "")).drop("new_gene")
    keep = F.row_number().over(W.partitionBy("cohort", "sample_id", "gene").orderBy("gene_ord"))
    return named.withColumn("_n", keep).filter("_n = 1").drop("_n")


def cardinality(df: DataFrame, item: str, group: str) -> DataFrame:
    """One row: distinct items, distinct groups, items of several groups, and the sorted items per group."""
    pairs = df.select(item, group).distinct()
    per = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    several = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_items"), F.count(F.when(F.col("n") > 1, 1)).alias("n_shared"))
    return several.crossJoin(per.agg(F.count(F.lit(1)).alias("n_groups"), F.array_join(F.sort_array(F.collect_list("n")).cast("array<string>"), "/").alias("items_per_group")))


def checked_cardinality(found: DataFrame, n_items: int, n_groups: int, items_per_group: str) -> DataFrame:
    """The row of `cardinality`, or an error where it is not as expected."""
    ok = (F.col("n_items") == n_items) & (F.col("n_groups") == n_groups) & (F.col("n_shared") == 0) & (F.col("items_per_group") == items_per_group)
    return found.withColumn("n_items", F.when(ok, F.col("n_items")).otherwise(F.raise_error(F.lit("unexpected cardinality")).cast("bigint")))


def appended(tables: list[DataFrame]) -> DataFrame:
    """All rows one below the other; a column that a table lacks is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def set_algebra(a: DataFrame, b: DataFrame, item: str, *keys: str) -> DataFrame:
    """Per key the sizes of intersection, differences and union of two item sets."""
    both = a.select(*keys, item).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys, item).distinct().withColumn("_b", F.lit(1)), [*keys, item], "full_outer")
    return both.groupBy(*keys).agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("n_only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("n_only_b"), F.count(F.lit(1)).alias("n_union"))


def ordered_union(*lists: Column) -> Column:
    """Elements of several lists in the order of their first appearance."""
    return F.array_distinct(F.filter(F.flatten(F.array(*lists)), lambda x: x.isNotNull() & (x != "")))


def first_rank(value: str, order: str, *keys: str) -> Column:
    """Rank from 1 in which ties go by their order; missing values have none."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last(), order))
    return F.when(F.col(value).isNotNull(), k)


def group_share(value: str, *keys: str) -> Column:
    """Value divided by the sum of absolute values of its group; missing where that is 0."""
    return F.col(value) / F.nullif(F.sum(F.abs(F.col(value))).over(W.partitionBy(*keys)), F.lit(0.0))


def leading_row(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in a full order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all there and finite."""
    from scoreloom.functions.stats import finite

    return df.filter(reduce(lambda a, b: a & b, [finite(F.col(c).cast("double")).isNotNull() for c in columns]))


def value_shares(df: DataFrame, flag: Column, value: str, *keys: str) -> DataFrame:
    """Per key: rows, share of rows where `flag` holds, distinct values and the most frequent one (ties: the smallest)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.sum(flag.cast("bigint")).alias("_t"))
    ranked = counts.withColumn("_k", -F.dense_rank().over(W.partitionBy(*keys).orderBy(value)))
    return ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum("_t") / F.sum("_n")).alias("share_true"), F.count(value).alias("n_distinct"), F.max(F.struct("_n", "_k", F.col(value).alias("v")))["v"].alias("most_frequent"))


def module_summary(strategies: DataFrame, coverage: DataFrame, locked: DataFrame) -> DataFrame:
    """Per module: how many scoring strategies agree in direction, how well they correlate, and a reading of it.

    `strategies`: module_label, concordant (boolean or missing), correlation; `coverage`: module_label, strategy,
    coverage_fraction; `locked`: module_label, hr_per_sd.
    """
    c = F.col("concordant").cast("double")
    s = strategies.groupBy("module_label").agg(F.count(F.lit(1)).alias("n_strategies"), F.coalesce(F.sum(c), F.lit(0.0)).cast("bigint").alias("n_concordant"), F.avg(c).alias("fraction_concordant"), F.min("correlation").alias("minimum_correlation"), F.median("correlation").alias("median_correlation"))
    k = coverage.groupBy("module_label").agg(*[F.max(F.when(F.col("strategy") == name, F.col("coverage_fraction"))).alias(out) for name, out in (("detected_50", "coverage_50"), ("detected_80", "coverage_80"))])
    both = locked.join(s, "module_label", "left").join(k, "module_label", "left").withColumn("locked_direction", F.col("hr_per_sd") > 1)
    high = F.col("minimum_correlation") >= 0.90
    reading = F.when((F.col("fraction_concordant") == 1) & high & (F.col("coverage_50") >= 0.70), "stable").when((F.col("fraction_concordant") == 0) & high, "discordant_throughout").otherwise("sensitive_or_limited")
    return both.withColumns({"n_strategies": F.coalesce("n_strategies", F.lit(0)), "n_concordant": F.coalesce("n_concordant", F.lit(0)), "interpretation": reading})
