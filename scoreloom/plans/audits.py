"""Queries of alignment, full inference tables, typed verifiers and inventories, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import stats, symbols
from scoreloom.operators import alignment, inference, inventory, localization, models, outcomes, preservation, resampling, stability, standardize, verify
from scoreloom.plans import standins as S
from scoreloom.plans.catalogue import _bulk, _genes, _probes, query, r, tidy

# ---- alignment --------------------------------------------------------------------------------------


@query("""with a as (select o_custkey as k from orders), b as (select c_custkey as k from customer), na as (select k, count(*) as n from a group by k), nb as (select k, count(*) as n from b group by k)
select count(na.k)::bigint as n_a, count(nb.k)::bigint as n_b, count(case when nb.k is null then 1 end)::bigint as only_a, count(case when na.k is null then 1 end)::bigint as only_b, count(case when na.n > 1 or nb.n > 1 then 1 end)::bigint as n_repeated,
  count(case when nb.k is null or na.k is null or na.n > 1 or nb.n > 1 then 1 end) = 0 as equal from na full join nb on na.k = nb.k""")
def key_family(spark, sf_dir):
    """Customers with orders against the list of customers."""
    return alignment.key_family(S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query(f"with {S.SQL_P_VALUES} select p_partkey, {r('p_value', 'a_p_value')}, {r('sqrt(p_value)', 'b_p_value')} from pv")
def aligned_tables(spark, sf_dir):
    """Two result tables with equal keys, side by side."""
    p = S.p_values(spark, sf_dir).select("p_partkey", "p_value")
    return tidy(alignment.aligned(p, p.withColumn("p_value", F.sqrt("p_value")), ["p_partkey"]))


@query(f"with {S.SQL_EXPRESSION} select t.position::bigint as position, t.m as module_label, count(*)::bigint as n_genes from (values (0, 'M2'), (1, 'M0'), (2, 'M3'), (3, 'M1')) t(position, m) left join wts on module_label = m group by all")
def fixed_module_order(spark, sf_dir):
    """Modules in a given order."""
    n = S.weights(spark).groupBy("module_label").agg(F.count(F.lit(1)).alias("n_genes"))
    return tidy(alignment.fixed_order(n, "module_label", ["M2", "M0", "M3", "M1"]).select("position", "module_label", "n_genes"))


@query("select p_brand as k, (row_number() over (order by min(p_partkey), p_brand) - 1)::bigint as position from part where p_brand is not null group by p_brand")
def first_appearance(spark, sf_dir):
    """Brands in the order of their first part."""
    return tidy(alignment.first_appearance(S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), "p_partkey"), "k", "p_partkey"))


@query("with f as (select l_suppkey as rep, l_linenumber as fold, avg(cast(l_quantity as double)) as a, avg(cast(l_extendedprice as double)) as b from lineitem group by all) select x.rep::bigint as rep, x.fold::bigint as fold, round(x.a - y.b, 6) + cast(0 as double) as delta from f x join f y on x.rep = y.rep and x.fold = y.fold")
def paired_folds(spark, sf_dir):
    """Two models' values of the same repeat and fold."""
    f = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rep"), F.col("l_linenumber").alias("fold"))
    a, b = f.agg(F.avg(F.col("l_quantity").cast("double")).alias("a")), f.agg(F.avg(F.col("l_extendedprice").cast("double")).alias("b"))
    joined = a.join(b, ["rep", "fold"]).withColumn("delta", F.round(F.col("a") - F.col("b"), 6) + F.lit(0.0))
    return joined.select(F.col("rep").cast("bigint").alias("rep"), F.col("fold").cast("bigint").alias("fold"), "delta")


@query("select doc_id from documents where doc_id in (select doc_id from labels) and doc_id in (select vec_id from embeddings) group by doc_id")
def common_samples(spark, sf_dir):
    """Identifiers that three tables share."""
    return alignment.common([S.table(spark, sf_dir, "documents").select("doc_id"), S.table(spark, sf_dir, "labels").select("doc_id"), S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))], "doc_id")


@query("with a as (select user_id as k, count(*) as n, avg(value) as m from events group by user_id), b as (select o_custkey as k, count(*) as n, avg(cast(o_totalprice as double)) as m from orders group by o_custkey) select coalesce(a.k, b.k)::bigint as k, a.n as events__n, round(a.m, 6) + cast(0 as double) as events__m, b.n as orders__n, round(b.m, 6) + cast(0 as double) as orders__m from a full join b on a.k = b.k")
def side_by_side(spark, sf_dir):
    """Two score tables in one, whatever keys they share."""
    e = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("value"), 6) + F.lit(0.0)).alias("m"))
    o = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg(F.col("o_totalprice").cast("double")), 6) + F.lit(0.0)).alias("m"))
    return alignment.side_by_side({"events": e, "orders": o}, "k")


ORTHO = "ort as (select 'g' || (p_partkey % 70) || ' ' as dog, case when p_partkey % 11 = 0 then null else 'h' || (p_partkey % 40) end as human, case p_partkey % 3 when 0 then 'strict_symbol_concordant_one_to_one' when 1 then 'not_transferable_or_unmapped' else 'ambiguous' end as status from part where p_partkey % 5 != 0 group by all)"


def _orthologs(spark, sf_dir):
    k = F.col("p_partkey")
    p = S.table(spark, sf_dir, "part").filter(k % 5 != 0)
    status = F.when(k % 3 == 0, "strict_symbol_concordant_one_to_one").when(k % 3 == 1, "not_transferable_or_unmapped").otherwise("ambiguous")
    return p.select(F.concat(F.lit("g"), (k % 70).cast("string"), F.lit(" ")).alias("dog_symbol"), F.when(k % 11 == 0, None).otherwise(F.concat(F.lit("h"), (k % 40).cast("string"))).alias("human_gene_symbol"), status.alias("ortholog_qc_status")).distinct()


@query(f"""with {S.SQL_EXPRESSION}, {ORTHO}, j as (select module_label, gene, loading, coalesce(upper(trim(human)), '') as human_gene_symbol, coalesce(status, 'not_found_in_ortholog_table') as ortholog_qc_status from wts left join ort on upper(trim(gene)) = upper(trim(dog)))
select module_label, gene, human_gene_symbol, ortholog_qc_status, human_gene_symbol != '' and ortholog_qc_status = 'strict_symbol_concordant_one_to_one' as is_strict_mapping, human_gene_symbol != '' and ortholog_qc_status not in ('not_transferable_or_unmapped', 'not_found_in_ortholog_table') as is_broad_mapping,
 case when human_gene_symbol != '' then count(*) over (partition by module_label, human_gene_symbol) else 0 end::bigint as human_symbol_duplicate_count, {r('loading / nullif(sum(abs(loading)) over (partition by module_label), 0)', 'normalized_weight')} from j""")
def mapped_weights(spark, sf_dir):
    """Weights through a one-to-many mapping."""
    found = alignment.mapped_weights(S.weights(spark), _orthologs(spark, sf_dir))
    return tidy(found.select("module_label", "gene", "human_gene_symbol", "ortholog_qc_status", "is_strict_mapping", "is_broad_mapping", "human_symbol_duplicate_count", "normalized_weight"))


@query(f"""with {S.SQL_EXPRESSION}, f as (select 'gene' as fc, module_label, gene as raw from wts union all select 'alias', module_label, ' ' || lower(gene) || ' ' from wts), e as (select 'brand' as ec, 'G' || (p_size % 30) as raw from part union all select 'type', 'g' || p_size from part),
fs as (select distinct fc, 'symbol' as scheme, module_label, upper(trim(raw)) as id from f union all select distinct fc, 'raw', module_label, raw from f), es as (select distinct ec, 'symbol' as scheme, upper(trim(raw)) as id from e union all select distinct ec, 'raw', raw from e),
sh as (select fc, ec, fs.scheme, module_label, fs.id from fs join es on fs.scheme = es.scheme and fs.id = es.id), per as (select fc, ec, scheme, module_label, count(*) as k from sh group by all)
select a.fc as frozen_column, b.ec as external_column, a.scheme, a.n as n_frozen, b.n as n_external, (select count(distinct id) from sh where sh.fc = a.fc and sh.ec = b.ec and sh.scheme = a.scheme) as n_overlap, (select count(*) from per where per.fc = a.fc and per.ec = b.ec and per.scheme = a.scheme and k >= 3) as n_modules
from (select fc, scheme, count(distinct id) as n from fs group by all) a join (select ec, scheme, count(*) as n from es group by all) b on a.scheme = b.scheme""")
def identifier_overlap(spark, sf_dir):
    """Which identifier columns and schemes meet, and in how many modules."""
    w = S.weights(spark)
    f = w.select(F.lit("gene").alias("column_name"), "module_label", F.col("gene").alias("raw")).unionByName(w.select(F.lit("alias").alias("column_name"), "module_label", F.concat(F.lit(" "), F.lower("gene"), F.lit(" ")).alias("raw")))
    p = S.table(spark, sf_dir, "part")
    e = p.select(F.lit("brand").alias("column_name"), F.concat(F.lit("G"), (F.col("p_size") % 30).cast("string")).alias("raw")).unionByName(p.select(F.lit("type").alias("column_name"), F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("raw")))

    def schemes(df, *keep):
        return df.select("column_name", *keep, F.lit("symbol").alias("scheme"), F.upper(F.trim("raw")).alias("id")).unionByName(df.select("column_name", *keep, F.lit("raw").alias("scheme"), F.col("raw").alias("id")))

    return alignment.identifier_overlap(schemes(f, "module_label"), schemes(e))


@query(f"""with {S.SQL_EXPRESSION}, m as (select 'G' || d as gene, case when d % 4 = 0 then 'N' || (d % 12) when d % 4 = 1 then '' end as new_gene, d as ord from (select unnest(range(64)) as d) where d % 3 != 2), fst as (select gene, arg_min(new_gene, ord) as new_gene from m where new_gene != '' group by gene),
n as (select cohort, sample_id, coalesce(new_gene, case when gene_ord % 2 = 1 then upper(trim(raw_expr.gene)) end) as gene, gene_ord, value from raw_expr left join fst on fst.gene = raw_expr.gene), k as (select *, row_number() over (partition by cohort, sample_id, gene order by gene_ord) as k from n where gene is not null and gene != '')
select cohort, gene, count(*)::bigint as n, min(gene_ord)::bigint as gene_ord, round(sum(value), 6) + cast(0 as double) as total from k where k = 1 group by cohort, gene""")
def remapped_expression(spark, sf_dir):
    """Genes under new names: mapped, else by their own symbol, first one kept."""
    d = F.col("id")
    mapping = spark.range(64).filter(d % 3 != 2).select(F.concat(F.lit("G"), d.cast("string")).alias("gene"), F.when(d % 4 == 0, F.concat(F.lit("N"), (d % 12).cast("string"))).when(d % 4 == 1, "").alias("new_gene"), d.alias("ord"))
    got = alignment.remapped(S.expression(spark, sf_dir), mapping, F.when(F.col("gene_ord") % 2 == 1, F.upper(F.trim("gene"))))
    return got.groupBy("cohort", "gene").agg(F.count(F.lit(1)).alias("n"), F.min("gene_ord").cast("bigint").alias("gene_ord"), (F.round(F.sum("value"), 6) + F.lit(0.0)).alias("total"))


@query("with p as (select distinct l_orderkey as item, l_suppkey as grp from lineitem), g as (select grp, count(*) as n from p group by grp), i as (select item, count(*) as n from p group by item) select (select count(*) from i) as n_items, (select count(*) from i where n > 1) as n_shared, count(*) as n_groups, array_to_string(list_sort(list(n)), '/') as items_per_group from g")
def cardinality(spark, sf_dir):
    """Orders per supplier, and orders with several suppliers."""
    return alignment.cardinality(S.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("select 'nation' as src, n_name as name, n_regionkey::bigint as region from nation union all select 'region', r_name, null from region")
def appended_tables(spark, sf_dir):
    """Tables one below the other, a lacking column missing."""
    n = S.table(spark, sf_dir, "nation").select(F.lit("nation").alias("src"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    return alignment.appended([n, S.table(spark, sf_dir, "region").select(F.lit("region").alias("src"), F.col("r_name").alias("name"))])


@query("with a as (select distinct p_brand as k, p_size as x from part where p_partkey % 2 = 0), b as (select distinct p_brand as k, p_size as x from part where p_partkey % 3 = 0) select coalesce(a.k, b.k) as k, count(case when a.x is not null and b.x is not null then 1 end)::bigint as n_both, count(case when b.x is null then 1 end)::bigint as n_only_a, count(case when a.x is null then 1 end)::bigint as n_only_b, count(*)::bigint as n_union from a full join b on a.k = b.k and a.x = b.x group by 1")
def set_algebra(spark, sf_dir):
    """Sizes of two parts of each brand, met and apart."""
    p = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("k"), F.col("p_size").alias("x"))
    return alignment.set_algebra(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 3 = 0"), "x", "k")


@query("with l as (select p_partkey, list_filter(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')), lambda x: x is not null and x != '') as l from part) select p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') as items from l")
def ordered_union(spark, sf_dir):
    """Words of type and name in the order of their first appearance."""
    return S.table(spark, sf_dir, "part").select("p_partkey", F.array_join(alignment.ordered_union(F.split("p_type", " "), F.split("p_name", " ")), ";").alias("items"))


@query(f"with {S.SQL_P_VALUES} select p_partkey, case when p_value is not null then row_number() over (partition by family order by round(p_value, 1) nulls last, p_partkey) end::bigint as k, {r('p_value / nullif(sum(abs(p_value)) over (partition by family), 0)', 'share')} from pv")
def first_rank(spark, sf_dir):
    """Ranks with ties by order, and values as shares of their family."""
    p = S.p_values(spark, sf_dir).withColumn("v", F.round("p_value", 1))
    return tidy(p.select("p_partkey", alignment.first_rank("v", "p_partkey", "family").alias("k"), alignment.group_share("p_value", "family").alias("share")))


@query("select l_suppkey::bigint as l_suppkey, l_orderkey::bigint as l_orderkey, l_linenumber::bigint as l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_discount, l_extendedprice desc, l_orderkey, l_linenumber) as k from lineitem) where k = 1")
def leading_row(spark, sf_dir):
    """The best line of each supplier in a full order."""
    got = alignment.leading_row(S.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return tidy(got.select("l_suppkey", "l_orderkey", "l_linenumber"))


@query("with v as (select l_returnflag as g, l_linestatus as v, count(*) as n, count(case when l_quantity > 25 then 1 end) as t from lineitem group by all), k as (select *, row_number() over (partition by g order by n desc, v) as k from v) select g, sum(n)::bigint as n, round(sum(t) / cast(sum(n) as double), 9) + cast(0 as double) as share_true, count(v)::bigint as n_distinct, max(case when k = 1 then v end) as most_frequent from k group by g")
def value_shares(spark, sf_dir):
    """Share of true, distinct values and the most frequent one."""
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("v"), "l_quantity")
    return tidy(alignment.value_shares(li, F.col("l_quantity") > 25, "v", "g"))


@query("with w as (select doc_id, cast(n_chars as double) as a, case when n_chars % 7 = 0 then null when n_chars % 5 = 0 then 'NaN'::double else 1 / cast(n_chars as double) end as b from documents where n_chars > 0) select doc_id, a, round(b, 9) + cast(0 as double) as b from w where b is not null and not isnan(b)")
def complete_cases(spark, sf_dir):
    """Rows whose model columns are all there and finite."""
    n = F.col("n_chars")
    d = S.table(spark, sf_dir, "documents").filter(n > 0).select("doc_id", n.cast("double").alias("a"), F.when(n % 7 == 0, None).when(n % 5 == 0, float("nan")).otherwise(1 / n.cast("double")).alias("b"))
    return tidy(alignment.complete_cases(d, ["a", "b"]))


STRATEGIES = """st as (select 'M' || (l_suppkey % 5) as module_label, l_linenumber as s, case when count(*) % 4 = 0 then null else avg(cast(l_quantity as double)) > 25 end as concordant, 0.85 + 0.15 * avg(cast(l_discount as double)) * 10 as correlation from lineitem where l_suppkey % 5 < 4 group by all),
cov as (select 'M' || (p_size % 5) as module_label, case p_size % 3 when 0 then 'detected_50' when 1 then 'detected_80' else 'all' end as strategy, max(p_size) / cast(50 as double) as coverage_fraction from part group by all), lock as (select 'M' || r_regionkey as module_label, 0.5 + r_regionkey / cast(3 as double) as hr_per_sd from region)"""


@query(f"""with {STRATEGIES}, s as (select module_label, count(*) as n, sum(cast(concordant as int)) as c, avg(cast(concordant as int)) as f, min(correlation) as lo, median(correlation) as mid from st group by 1), k as (select module_label, max(case when strategy = 'detected_50' then coverage_fraction end) as c50, max(case when strategy = 'detected_80' then coverage_fraction end) as c80 from cov group by 1)
select lock.module_label, {r('hr_per_sd', 'hr_per_sd')}, hr_per_sd > 1 as locked_direction, coalesce(n, 0)::bigint as n_strategies, coalesce(c, 0)::bigint as n_concordant, {r('f', 'fraction_concordant')}, {r('lo', 'minimum_correlation')}, {r('mid', 'median_correlation')}, {r('c50', 'coverage_50')}, {r('c80', 'coverage_80')},
 case when f = 1 and lo >= 0.9 and c50 >= 0.7 then 'stable' when f = 0 and lo >= 0.9 then 'discordant_throughout' else 'sensitive_or_limited' end as interpretation from lock left join s using (module_label) left join k using (module_label)""")
def module_summary(spark, sf_dir):
    """Scoring strategies of a module: agreement, correlation, coverage and a reading."""
    li = S.table(spark, sf_dir, "lineitem").filter("l_suppkey % 5 < 4").withColumn("module_label", F.concat(F.lit("M"), (F.col("l_suppkey") % 5).cast("string")))
    st = li.groupBy("module_label", "l_linenumber").agg(F.when(F.count(F.lit(1)) % 4 == 0, None).otherwise(F.avg(F.col("l_quantity").cast("double")) > 25).alias("concordant"), (0.85 + 1.5 * F.avg(F.col("l_discount").cast("double"))).alias("correlation"))
    size = F.col("p_size")
    cov = S.table(spark, sf_dir, "part").groupBy(F.concat(F.lit("M"), (size % 5).cast("string")).alias("module_label"), F.when(size % 3 == 0, "detected_50").when(size % 3 == 1, "detected_80").otherwise("all").alias("strategy")).agg((F.max("p_size") / 50.0).alias("coverage_fraction"))
    lock = S.table(spark, sf_dir, "region").select(F.concat(F.lit("M"), F.col("r_regionkey").cast("string")).alias("module_label"), (0.5 + F.col("r_regionkey") / 3.0).alias("hr_per_sd"))
    return tidy(alignment.module_summary(st, cov, lock))


@query("select l_suppkey % 10 as module_label, l_linenumber::bigint as sample, l_suppkey::bigint as probe from (select *, row_number() over (partition by l_suppkey % 10, l_linenumber order by l_discount, l_quantity desc, l_suppkey, l_orderkey) as k from lineitem) where k = 1")
def best_probe(spark, sf_dir):
    """The best detected probe of each module and sample."""
    li = S.table(spark, sf_dir, "lineitem").withColumn("module_label", F.col("l_suppkey") % 10)
    got = alignment.leading_row(li, ["module_label", "l_linenumber"], "l_discount", F.desc("l_quantity"), "l_suppkey", "l_orderkey")
    return got.select("module_label", F.col("l_linenumber").cast("bigint").alias("sample"), F.col("l_suppkey").cast("bigint").alias("probe"))


# ---- cleaning of odd values -------------------------------------------------------------------------

#: Odd cells of a numeric column.
ODD_CELLS = ("1.5", " 2 ", "", "abc", "nan", "inf", "-inf", "1e3", "-0.0", "NA")


@query("""with v as (select p_partkey, p_type as gene, list_extract(['1.5', ' 2 ', '', 'abc', 'nan', 'inf', '-inf', '1e3', '-0.0', 'NA'], (p_partkey % 10 + 1)::int) as cell from part), n as (select p_partkey, gene, try_cast(trim(cell) as double) as x from v), f as (select p_partkey, gene, case when isnan(x) or isinf(x) then null else x end as x from n)
select p_partkey, coalesce(x, median(x) over (partition by gene)) + cast(0 as double) as value from f""")
def imputed_cells(spark, sf_dir):
    """Text cells as numbers: bad, infinite and missing ones take the gene's median."""
    from pyspark.sql import Window as W

    cells = F.array(*map(F.lit, ODD_CELLS))
    p = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("gene"), F.get(cells, (F.col("p_partkey") % 10).cast("int")).alias("cell"))
    v = p.withColumn("x", stats.finite(F.trim("cell").try_cast("double")))
    return v.select("p_partkey", (F.coalesce("x", F.median("x").over(W.partitionBy("gene"))) + F.lit(0.0)).alias("value"))


@query("select event_type, round(avg(cast(value > 50 as int)), 9) + cast(0 as double) as detected from events group by event_type")
def detection_fraction(spark, sf_dir):
    """Share of rows above a level, per type."""
    e = S.table(spark, sf_dir, "events").withColumn("v", F.col("value") - 50)
    return tidy(localization.detection_fraction(e, "event_type", "v"))


@query("with a as (select p_partkey, p_type as status, case when p_partkey % 3 = 0 then null else 'old' end as note from part), d as (select p_partkey, 'superseded' as status, case when p_partkey % 2 = 0 then 'old' else 'new' end as note from part where p_partkey % 4 < 2) select a.p_partkey, coalesce(d.status, a.status) as status, case when d.note is null or contains(coalesce(a.note, ''), d.note) then a.note when coalesce(a.note, '') = '' then d.note else a.note || '; ' || d.note end as note from a left join d using (p_partkey)")
def decisions(spark, sf_dir):
    """Decisions merged into an inventory; a note is added once."""
    k = F.col("p_partkey")
    p = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("status"), F.when(k % 3 == 0, None).otherwise("old").alias("note"))
    d = p.filter(k % 4 < 2).select("p_partkey", F.lit("superseded").alias("status"), F.when(k % 2 == 0, "old").otherwise("new").alias("note"))
    return verify.decided(p, d, "p_partkey").select("p_partkey", "status", "note")


# ---- typed verifiers and gates ----------------------------------------------------------------------

SQL_COVERAGE_TABLE = "ct as (select p_brand as k, count(*)::bigint as n, avg(p_size) as f, max(p_size) > 49 as ok, string_agg(distinct p_type, ';' order by p_type) as items, case when count(*) % 2 = 0 then null else '' end as reason from part group by p_brand)"


@query(f"""with {SQL_COVERAGE_TABLE}, o as (select k, case when n % 5 = 0 then n + 1 else n end as n, f * (1 + 1e-9) as f, ok, replace(items, ';', ' ; ') as items, coalesce(reason, '') as reason from ct where k not like '%1'), j as (select c.*, o.k is not null as here, o.n as o_n, o.f as o_f from ct c left join o using (k))
select column_name, kind, one as n_one_sided, bad as n_mismatches, case when kind = 'close' then round(gap, 9) + cast(0 as double) end as largest_difference, one = 0 and bad = 0 as passed from (select count(case when not here then 1 end)::bigint as one, count(case when here and n != o_n then 1 end)::bigint as bn, count(case when here and abs(o_f - f) > 1e-10 + 1e-8 * abs(f) then 1 end)::bigint as bf, max(abs(f - o_f)) as gap from j),
lateral (select unnest(['n', 'f', 'ok', 'items', 'reason']) as column_name, unnest(['exact', 'close', 'exact', 'list', 'text']) as kind, unnest([bn, bf, 0, 0, 0]) as bad)""")
def coverage_verifier(spark, sf_dir):
    """A coverage table against a changed copy: counts, fractions, booleans, lists and texts."""
    t = S.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("f"), (F.max("p_size") > 49).alias("ok"), F.array_join(F.sort_array(F.collect_set("p_type")), ";").alias("items"), F.when(F.count(F.lit(1)) % 2 == 0, None).otherwise("").alias("reason"))
    o = t.filter(~F.col("k").like("%1")).withColumns({"n": F.when(F.col("n") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")), "f": F.col("f") * (1 + 1e-9), "items": F.replace("items", F.lit(";"), F.lit(" ; ")), "reason": F.coalesce("reason", F.lit(""))})
    return tidy(inventory.typed_comparison(t, o, ["k"], {"n": "exact", "f": "close", "ok": "exact", "items": "list", "reason": "text"}))


@query(f"with {S.SQL_EXPRESSION}, e as (select cohort, gene, avg(value) as m, stddev_samp(value) as s from raw_expr group by all), o as (select cohort, gene, m, case when gene = 'G3' then s + 1e-3 else s end as s from e), l as (select e.m as em, o.m as om, e.s as es, o.s as os from e join o using (cohort, gene)) select metric, n::bigint as n_rows, bad::bigint as n_mismatches, 0::bigint as n_one_sided, {r('gap', 'max_difference')}, bad = 0 as passed from (select 'mean' as metric, count(*) as n, 0 as bad, cast(0 as double) as gap from l union all select 'sd', count(*), count(case when abs(es - os) > 1e-12 + 1e-10 * abs(es) then 1 end), max(abs(es - os)) from l)")
def structure_verifier(spark, sf_dir):
    """Several metrics of every gene against a changed copy, within 1e-12 and 1e-10."""
    t = standardize.gene_statistics(S.expression(spark, sf_dir)).select("cohort", "gene", "mean", "sd")
    o = t.withColumn("sd", F.when(F.col("gene") == "G3", F.col("sd") + 1e-3).otherwise(F.col("sd")))
    found = verify.verdict(verify.compared(t, o, ["cohort", "gene"], ["mean", "sd"], 1e-12, 1e-10))
    return tidy(found.toDF("metric", "n_rows", "n_mismatches", "n_one_sided", "max_difference", "passed"))


@query("with t as (select page_id::varchar as name, sha256(html) as p, sha256(replace(replace(html, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) as c from pages), rec as (select page_id::varchar as name, case page_id % 3 when 0 then sha256(html) when 1 then sha256(replace(replace(html, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) else sha256('x') end as s from pages union all select 'gone', sha256('gone')) select name, case when s = p then 'as_is' when s = c then 'crlf' when p is null then 'absent' else 'none' end as form, coalesce(s = p or s = c, false) as passed from rec left join t using (name)")
def hash_gate(spark, sf_dir):
    """Recorded hashes against content, in both line-end forms."""
    found = verify.hash_forms(S.table(spark, sf_dir, "pages"), "html").select(F.col("page_id").cast("string").alias("name"), F.col("page_id").alias("k"), "sha256_plain", "sha256_crlf")
    s = F.when(F.col("k") % 3 == 0, F.col("sha256_plain")).when(F.col("k") % 3 == 1, F.col("sha256_crlf")).otherwise(F.sha2(F.lit("x"), 256))
    gone = spark.range(1).select(F.lit("gone").alias("name"), F.sha2(F.lit("gone"), 256).alias("sha256"))
    return inventory.hash_gate(found.select("name", s.alias("sha256")).unionByName(gone), found.drop("k"))


@query()
def table_probe(spark, sf_dir):
    """Columns, rows and an order-free digest of a table."""
    return inventory.table_probe(S.table(spark, sf_dir, "part"))


@query("""with t as (select p_partkey, list_extract(['?? a/b', ' M x y', 'R  old -> new', 'AD z', 'UU w', 'x', 'A  n'], (p_partkey % 7 + 1)::int) as line from part) select p_partkey, line[1] as index_status, line[2] as worktree_status, case when contains(line, ' -> ') then 'new' else line[4:] end as path, case when contains(line, ' -> ') then 'old' else '' end as original_path,
case when line[1:2] = '??' then 'untracked' when contains(line[1:2], 'D') then 'deleted' when contains(line[1:2], 'R') then 'renamed' when contains(line[1:2], 'A') then 'added' when contains(line[1:2], 'M') then 'modified' else 'other' end as status from t where len(line) >= 4""")
def status_listing(spark, sf_dir):
    """Lines of a status listing, read and classed."""
    lines = F.array(*map(F.lit, ("?? a/b", " M x y", "R  old -> new", "AD z", "UU w", "x", "A  n")))
    p = S.table(spark, sf_dir, "part").select("p_partkey", F.get(lines, (F.col("p_partkey") % 7).cast("int")).alias("t"))
    return inventory.porcelain(p, "p_partkey", "t").drop("line_no")


@query("with s as (select p_brand as name, string_agg(distinct p_type, ';' order by p_type) as v from part where p_size < 5 group by 1), m as (select p_brand as name, string_agg(distinct p_type, ';' order by p_type) as v from part where p_size between 3 and 4 or p_size = 50 group by 1) select coalesce(s.name, m.name) as name, s.v as script_version, m.v as manifest_version, case when s.v is null then 'manifest_only' when m.v is null then 'script_only' when s.v = m.v then 'agree' else 'differ' end as state from s full join m on s.name = m.name")
def version_agreement(spark, sf_dir):
    """Versions by script and by manifest."""
    p = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("version"), "p_size")
    return inventory.version_agreement(p.filter("p_size < 5"), p.filter("p_size between 3 and 4 or p_size = 50"))


@query(f"""with {S.SQL_EXPRESSION}, v as (select cohort, gene, var_samp(value) as raw from raw_expr group by all), k as (select *, least(floor({S.sql_rank('raw', 'cohort')} / count(*) over (partition by cohort) * 10), 9) as b, 5 as scaled_bin from v)
select cohort, count(*)::bigint as n_genes, {r('avg(cast(b = scaled_bin as int))', 'agreement')}, count(distinct b)::bigint as n_raw_bins, 1::bigint as n_scaled_bins, {r('min(raw)', 'raw_minimum')}, {r('max(raw)', 'raw_maximum')}, {r('median(raw)', 'raw_median')} from k group by cohort""")
def variability_audit(spark, sf_dir):
    """Variance bins of raw values against those of standardised ones, which all tie."""
    return tidy(inventory.variability_audit(S.expression(spark, sf_dir)))


# ---- inference tables -------------------------------------------------------------------------------


@query()
def inference_table(spark, sf_dir):
    """Both permutation tests of every module (5000 repeats), with q values of the joint family."""
    genes = _genes(spark, sf_dir)
    return tidy(inference.inference_table(preservation.edges_by_matrix(genes), preservation.leading_component(genes, "external"), genes.filter(F.col("cohort") == "external"), S.weights(spark), "reference", "external"))


@query()
def reliability_table(spark, sf_dir):
    """Split halves (2000 repeats) and leave-one-out of every module."""
    genes = _genes(spark, sf_dir).filter(F.col("cohort") == "external")
    sizes = {f"M{m}": 16 for m in range(4)}
    schedule = resampling.permutation_schedule(spark, sizes, {k: resampling.permutation_seeds(i)[2] for i, k in enumerate(sizes)}, 2000)
    from pyspark.sql import Window as W

    placed = genes.withColumn("pos", F.dense_rank().over(W.partitionBy("module_label").orderBy("ord")) - 1)
    return tidy(inference.reliability_table(resampling.split_half(placed, schedule), genes, S.weights(spark)))


@query(f"""with {S.SQL_P_VALUES}, s as (select family, count(*) as n, count(case when p_value > 0.3 then 1 end) as k from pv where p_value is not null and p_value != 0.3 group by family), t as (select *, least(k, n - k) as lo from s)
select family, n::bigint as n, k::bigint as n_positive, {r('least(1, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from range(0, lo + 1) u(i)))', 'p_two_sided')} from t where n <= 1000""")
def sign_test(spark, sf_dir):
    """Exact sign test of families up to 1000 differences, as its SQL has them; larger ones are in `sign_test_large`."""
    return _sign_tests(spark, sf_dir).filter("n <= 1000")


@query(f"""with {S.SQL_P_VALUES}, s as (select family, count(*) as n, count(case when p_value > 0.3 then 1 end) as k from pv where p_value is not null and p_value != 0.3 group by family), z as (select *, greatest(0, abs(k - n / 2::double) - 0.5) / sqrt(n / 4::double) as z from s), t as (select *, 1 / (1 + 0.2316419::double * z) as t from z)
select family, n::bigint as n, k::bigint as n_positive, {r('least(1, 2 * exp(-z * z / 2) * 0.3989422804014327::double * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))', 'p_two_sided')} from t where n > 1000""")
def sign_test_large(spark, sf_dir):
    """Sign test of the families beyond 1000 differences, by the normal approximation."""
    return _sign_tests(spark, sf_dir).filter("n > 1000")


def _sign_tests(spark, sf_dir):
    return tidy(inference.sign_test(S.p_values(spark, sf_dir).withColumn("d", F.col("p_value") - 0.3), "d", "family"))


@query()
def paired_contrasts(spark, sf_dir):
    """Contrasts of cell types over donors, with intervals, exact p and q."""
    types = [x[0] for x in _bulk(spark, sf_dir).select("cell_type").distinct().orderBy("cell_type").limit(3).collect()]
    schedule = spark.range(400 * 6).select((F.col("id") % 400).alias("rep"), F.floor(F.col("id") / 400).cast("int").alias("pos"), F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("idx"))
    return tidy(inference.paired_contrasts(_bulk(spark, sf_dir), "donor", "cell_type", [(types[0], types[1]), (types[1], types[2]), (types[0], "none")], schedule))


@query()
def contrast_tiers(spark, sf_dir):
    """Models compared over paired folds."""
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("endpoint"), F.col("l_linestatus").alias("module_label"), F.concat(F.lit("m"), (F.col("l_linenumber") % 4).cast("string")).alias("model"), (F.col("l_orderkey") % 7).alias("repeat"), F.col("l_suppkey").alias("fold"), (F.col("l_discount").cast("double") * 10).alias("c_index"))
    schedule = spark.range(200 * 7).select((F.col("id") % 200).alias("rep"), F.floor(F.col("id") / 200).cast("int").alias("pos"), F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("idx"))
    return tidy(inference.contrast_tiers(li, [("m0", "m1"), ("m2", "m3")], schedule))


def _cohort(spark, sf_dir):
    """A cohort of 300 customers: mean order price, days of the first order, and whether one is open. A stated cohort, as the method is for hundreds."""
    o = S.survival(spark, sf_dir).join(S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    per = o.groupBy((F.col("o_custkey") % 300).alias("sample")).agg(F.max("time").alias("time"), F.max_by("event", "o_orderkey").alias("event"), F.avg("score").alias("score"))
    return per


@query()
def bootstrap_cox(spark, sf_dir):
    """Coefficient of a hazard model under stratified draws of samples."""
    return tidy(stability.bootstrap_cox(_cohort(spark, sf_dir), "sample", "time", "event", "score", 200))


@query()
def leave_one_out_cox(spark, sf_dir):
    """Coefficient of a hazard model without each sample in turn."""
    return tidy(stability.leave_one_out_cox(_cohort(spark, sf_dir), "sample", "time", "event", "score"))


@query()
def subsample_modules(spark, sf_dir):
    """Modules found anew in 80 % of the samples, thirty times."""
    z = standardize.standardised(standardize.normalised(S.expression(spark, sf_dir))).filter("cohort = 'external'")
    return tidy(stability.subsample_modules(z, S.weights(spark).select("module_label", "gene"), 30, 0.8, 0.02, 3))


@query()
def component_scores(spark, sf_dir):
    """Uncentred component scores of each module, and weights turned towards an outcome."""
    genes = _genes(spark, sf_dir)
    scores = stability.component_scores(genes, "external")
    ends = S.survival(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("sample_id"), "time", "event")
    rows = scores.join(ends, "sample_id")
    fits = [models.cox(rows.filter(c).withColumn("event", e), "time", "event", "score", "module_label").withColumn("endpoint", F.lit(n)) for n, c, e in (("DFI", "module_label in ('M0', 'M1')", F.col("event")), ("OS", "module_label != 'M3'", 1 - F.col("event")))]
    turned = stability.oriented_weights(genes, "external", scores, fits[0].unionByName(fits[1]))
    summary = scores.groupBy("module_label").agg(F.count("score").alias("n_samples"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    apart = stability.component_scores(genes, "external", without=S.weights(spark).filter("ord % 8 < 4")).groupBy("module_label").agg(F.count("score").alias("n_disjoint"))
    length = turned.groupBy("module_label").agg(F.count(F.lit(1)).alias("n_genes"), F.sum(F.col("risk_loading") * F.col("risk_loading")).alias("length"), F.max("endpoint").alias("endpoint"))
    return tidy(summary.join(length, "module_label").join(apart, "module_label", "left"))


@query()
def corrected_t_p(spark, sf_dir):
    """Corrected t with its p value."""
    return tidy(outcomes.corrected_t(S.p_values(spark, sf_dir).withColumn("d", F.col("p_value") - 0.3), "d", 5, "family"))


@query(f"with {S.SQL_EXPRESSION} select upper(trim(gene)) as symbol, count(*)::bigint as n from raw_expr group by 1")
def normalised_symbols(spark, sf_dir):
    """Symbols trimmed and in capitals."""
    e = S.expression(spark, sf_dir).withColumn("gene", F.concat(F.lit(" "), F.lower("gene"), F.lit(" ")))
    return standardize.normalised(e).groupBy(F.col("gene").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
