"""Registered queries over the shared tables, each with its SQL twin where SQL can express it.

Doubles are rounded to 9 digits on both sides: the engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions import stats, symbols
from scoreloom.operators import localization, outcomes, preservation, resampling, scoring, sets, standardize, verify
from scoreloom.plans import standins as S
from scoreloom.schemas import ScoringRule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 9


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded (and -0 made 0), counts as long, for comparison across engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.round(c, DIGITS) + F.lit(0.0)
        elif kind in ("int", "bigint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def r(x: str, name: str) -> str:
    return f"round({x}, {DIGITS}) + cast(0 as double) as {name}"


def _z(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    expr = standardize.normalised(S.expression(spark, sf_dir))
    return expr, standardize.standardised(expr), scoring.frozen_program(S.weights(spark))


# ---- multiplicity -----------------------------------------------------------------------------------

BH = """
bh as (
  select *, count(p_value) over (partition by family) as m, row_number() over (partition by family order by p_value nulls last, p_partkey) as k from pv
), qv as (
  select *, case when p_value is not null then greatest(0, least(1, min(p_value * m / k) over (partition by family order by p_value nulls last, p_partkey rows between current row and unbounded following))) end as q_value from bh
)"""


@query(f"with {S.SQL_P_VALUES}, {BH} select p_partkey, family, {r('p_value', 'p_value')}, {r('q_value', 'q_value')}, coalesce(q_value < 0.05, false) as supported, cast(m as bigint) as family_size from qv")
def multiplicity(spark, sf_dir):
    """Benjamini-Hochberg within families, with the strict mask."""
    q = stats.benjamini_hochberg(S.p_values(spark, sf_dir), "p_value", "family", order="p_partkey", size="family_size")
    return tidy(q.withColumn("supported", stats.significant("q_value", 0.05)).select("p_partkey", "family", "p_value", "q_value", "supported", "family_size"))


@query(f"""with {S.SQL_P_VALUES}, two as (
  select p_partkey, family, 'edge' as kind, 2 * p_partkey as o, p_value as p from pv union all
  select p_partkey, family, 'loading', 2 * p_partkey + 1, sqrt(p_value) from pv
), b as (select *, count(p) over (partition by family) as m, row_number() over (partition by family order by p nulls last, o) as k from two
), q as (select *, case when p is not null then least(1, min(p * m / k) over (partition by family order by p nulls last, o rows between current row and unbounded following)) end as q from b)
select p_partkey, {r("max(case when kind = 'edge' then q end)", 'edge_q')}, {r("max(case when kind = 'loading' then q end)", 'loading_q')}, cast(max(m) as bigint) as family_size from q group by p_partkey""")
def joint_multiplicity(spark, sf_dir):
    """Two tests of each item corrected in one family per type, then side by side again."""
    p = S.p_values(spark, sf_dir)
    long = p.select("p_partkey", "family", F.col("p_value").alias("edge"), F.sqrt("p_value").alias("loading")).unpivot(["p_partkey", "family"], ["edge", "loading"], "kind", "p")
    long = long.withColumn("o", 2 * F.col("p_partkey") + (F.col("kind") == "loading").cast("int"))
    q = stats.benjamini_hochberg(long, "p", "family", order="o", size="family_size")
    return tidy(q.groupBy("p_partkey").agg(F.max(F.when(F.col("kind") == "edge", F.col("q_value"))).alias("edge_q"), F.max(F.when(F.col("kind") == "loading", F.col("q_value"))).alias("loading_q"), F.max("family_size").alias("family_size")))


# ---- frozen scoring ---------------------------------------------------------------------------------

RAW_SCORES = """
raw as (
  select cohort, module_label, sample_id, avg(sgn * z) as signed_mean, sum(loading * z) / nullif(sum(abs(loading)), 0) as weighted from mg group by all
), long_scores as (
  select cohort, module_label, sample_id, 'signed_mean' as score_name, signed_mean as v from raw union all select cohort, module_label, sample_id, 'weighted', weighted from raw
)"""


@query(f"with {S.SQL_EXPRESSION}, {RAW_SCORES} select cohort, module_label, score_name, sample_id, {r('(v - avg(v) over w) / nullif(stddev_samp(v) over w, 0)', 'value')} from long_scores window w as (partition by cohort, module_label, score_name)")
def frozen_scores(spark, sf_dir):
    """Signed mean and weighted scores of frozen programs, standardised within the cohort."""
    return tidy(scoring.scores(*_z(spark, sf_dir)).select("cohort", "module_label", "score_name", "sample_id", "value"))


@query(f"with {S.SQL_EXPRESSION}, {RAW_SCORES}, s as (select *, (v - avg(v) over w) / nullif(stddev_samp(v) over w, 0) as x from long_scores window w as (partition by cohort, module_label, score_name)) select cohort, sample_id, " + ", ".join(r(f"max(case when module_label = 'M{m}' and score_name = '{a}' then x end)", f"M{m}__strict__{b}") for m in range(4) for a, b in (("signed_mean", "signed_mean_z"), ("weighted", "canine_pca_weighted_z"))) + " from s group by cohort, sample_id")
def wide_scores(spark, sf_dir):
    """The scores as one row per sample."""
    return tidy(scoring.wide_scores(scoring.scores(*_z(spark, sf_dir)), "strict", ["M0", "M1", "M2", "M3"]))


@query("""with w as (select 'M' || (d % 4) as module_label, 'G' || d as gene, d as ord from (select unnest(range(64)) as d)),
have as (select distinct case when label % 2 = 0 then 'reference' else 'external' end as cohort, 'G' || d as gene from embeddings, (select unnest(range(64)) as d) where d % 9 != 0),
c as (select distinct cohort from have)
select c.cohort, w.module_label, count(*)::bigint as n_frozen_genes, count(h.gene)::bigint as n_available_genes,
  coalesce(string_agg(case when h.gene is not null then w.gene end, ';' order by ord), '') as available_genes, coalesce(string_agg(case when h.gene is null then w.gene end, ';' order by ord), '') as missing_genes,
  round(count(h.gene) / cast(count(*) as double), 9) + cast(0 as double) as coverage_fraction, count(h.gene) >= 15 and count(h.gene) / cast(count(*) as double) >= 0.5 as minimum_rule_passed
from c cross join w left join have h on h.cohort = c.cohort and h.gene = w.gene group by c.cohort, w.module_label""")
def score_coverage(spark, sf_dir):
    """Available and missing genes of each program, when every ninth gene is absent."""
    expr = standardize.normalised(S.expression(spark, sf_dir).filter("gene_ord % 9 != 0"))
    found = scoring.coverage(expr, standardize.standardised(expr), scoring.frozen_program(S.weights(spark)), ScoringRule(minimum_genes=15))
    return tidy(found.drop("n_scored_genes", "estimable"))


@query(f"with {S.SQL_EXPRESSION} select cohort, module_label, sample_id, {r('sum(case when loading > 0 then loading * z else 0 end) / nullif(sum(abs(loading)), 0)', 'positive')}, {r('sum(case when loading < 0 then loading * z else 0 end) / nullif(sum(abs(loading)), 0)', 'negative')}, {r('sum(loading * z) / nullif(sum(abs(loading)), 0)', 'signed')} from mg group by all")
def score_components(spark, sf_dir):
    """Positive and negative parts of the weighted score."""
    _, z, w = _z(spark, sf_dir)
    return tidy(scoring.components(z, w))


@query(f"with {S.SQL_EXPRESSION} select cohort, gene, count(value)::bigint as n, {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, {r('stddev_samp(value)', 'sd')}, {r('var_samp(value)', 'variance')} from raw_expr group by cohort, gene")
def gene_statistics(spark, sf_dir):
    """Mean, median and spread of each gene."""
    return tidy(standardize.gene_statistics(S.expression(spark, sf_dir)))


@query(f"with {S.SQL_EXPRESSION}, g as (select cohort, gene, var_samp(value) as variance from raw_expr group by cohort, gene), k as (select *, row_number() over (partition by cohort order by variance desc, gene) as position, rank() over (partition by cohort order by variance) / cast(count(*) over (partition by cohort) as double) as percentile from g) select cohort, gene, {r('variance', 'variance')}, position::bigint as position, {r('percentile', 'percentile')} from k where position <= 20")
def top_variance_genes(spark, sf_dir):
    """The twenty most variable genes of each cohort."""
    return tidy(standardize.top_variance_genes(S.expression(spark, sf_dir), 20))


@query("""with v as (select l_returnflag as cohort, l_orderkey || '-' || l_linenumber as sample_id, cast(l_extendedprice as double) as value from lineitem), f as (select cohort, min(value) as lo, max(value) as hi, median(value) as mid from v group by cohort)
select cohort, count(*)::bigint as n, round(sum(case when lo >= 0 and (hi > 50 or mid > 10) then log2(value + 1) else value end), 4) + cast(0 as double) as total from v join f using (cohort) group by cohort""")
def log_rule(spark, sf_dir):
    """Values on a count-like scale are logged, by a rule on the whole cohort."""
    v = S.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cohort"), F.col("l_extendedprice").cast("double").alias("value"))
    return standardize.log_rule(v).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("total"))


# ---- preservation -----------------------------------------------------------------------------------

EDGES = f"""
edges as (
  select a.cohort, a.module_label, a.ord as i, b.ord as j, {S.sql_corr('a.z', 'b.z')} as r
  from mg a join mg b on a.cohort = b.cohort and a.module_label = b.module_label and a.sample_id = b.sample_id and a.ord < b.ord group by all
), both_edges as (
  select e.module_label, e.i, e.j, e.r as r_ref, x.r as r_ext from edges e join edges x on e.module_label = x.module_label and e.i = x.i and e.j = x.j where e.cohort = 'reference' and x.cohort = 'external'
), ranked_edges as (
  select module_label, i, j, {S.sql_rank('r_ref', 'module_label')} as rr, {S.sql_rank('r_ext', 'module_label')} as re from both_edges
)"""


def _genes(spark, sf_dir):
    _, z, w = _z(spark, sf_dir)
    return preservation.module_genes(z, w)


@query(f"with {S.SQL_EXPRESSION}, {EDGES} select cohort, module_label, cast(i as bigint) as i, cast(j as bigint) as j, {r('r', 'r')} from edges")
def module_edges(spark, sf_dir):
    """Gene-gene correlations of each module and cohort."""
    return tidy(preservation.edges(_genes(spark, sf_dir)))


@query(f"with {S.SQL_EXPRESSION}, {EDGES} select cohort, module_label, cast(i as bigint) as i, cast(j as bigint) as j, {r('r', 'r')} from edges")
def module_edges_by_matrix(spark, sf_dir):
    """The same by one matrix product per module and cohort."""
    return tidy(preservation.edges_by_matrix(_genes(spark, sf_dir)))


@query(f"with {S.SQL_EXPRESSION}, {EDGES} select module_label, {r(S.sql_corr('rr', 're'), 'spearman')} from ranked_edges group by module_label")
def edge_preservation(spark, sf_dir):
    """Spearman correlation of both cohorts' edges."""
    return tidy(preservation.edge_preservation(preservation.edges(_genes(spark, sf_dir)), "reference", "external"))


@query("""with w as (select 'M' || (d % 4) as module_label, 'G' || d as gene, d as ord from (select unnest(range(64)) as d)),
s as (select w.*, d2.e, d2.f from w left join (select 'G' || d as gene, d % 7 != 0 as e, d % 5 != 0 as f from (select unnest(range(64)) as d)) d2 using (gene))
select module_label, count(*)::bigint as n_frozen_genes, count(case when e and f then 1 end)::bigint as n_common_genes, coalesce(string_agg(case when e and f then gene end, ';' order by ord), '') as common_genes, coalesce(string_agg(case when not e then gene end, ';' order by ord), '') as missing_external_genes,
 round(count(case when e and f then 1 end) / cast(count(*) as double), 9) + cast(0 as double) as coverage_fraction, count(case when e and f then 1 end) >= 3 as estimable, case when count(case when e and f then 1 end) >= 3 then '' else 'fewer_than_3_common_genes' end as nonestimable_reason from s group by module_label""")
def preservation_coverage(spark, sf_dir):
    """Common genes when each cohort lacks some."""
    _, z, w = _z(spark, sf_dir)
    d = F.substring("gene", 2, 9).cast("int")
    some = z.filter(((F.col("cohort") == "external") & (d % 7 != 0)) | ((F.col("cohort") == "reference") & (d % 5 != 0)))
    return tidy(preservation.coverage(some, w, "external"))


@query()
def leading_component(spark, sf_dir):
    """First principal component of each module, turned towards the frozen score."""
    return tidy(preservation.leading_component(_genes(spark, sf_dir), "external"))


@query()
def loading_preservation(spark, sf_dir):
    """Spearman correlation of external and frozen loadings."""
    return tidy(preservation.loading_preservation(preservation.leading_component(_genes(spark, sf_dir), "external")))


@query(f"with {S.SQL_EXPRESSION} select cohort, module_label, sample_id, {r('avg(sgn * z)', 'score')} from mg group by all")
def frozen_signed_mean(spark, sf_dir):
    """Signed means that are not standardised again."""
    return tidy(preservation.frozen_signed_mean(_genes(spark, sf_dir)))


# ---- resampling -------------------------------------------------------------------------------------

REPEATS = 20
#: A schedule by arithmetic, so that both engines make the same one: place k of 16 goes to (a k + b) mod 17, without 16.
SQL_SCHEDULE = f"""
sched as (
  select 'M' || m as module_label, rep, pos, (row_number() over (partition by m, rep order by ((3 + rep) * (pos + 1)) % 17, pos)) - 1 as idx
  from (select unnest(range(4)) as m), (select unnest(range({REPEATS})) as rep), (select unnest(range(16)) as pos)
)"""


def _schedule(spark: SparkSession) -> DataFrame:
    base = spark.range(4 * REPEATS * 16).select(F.concat(F.lit("M"), (F.col("id") % 4).cast("string")).alias("module_label"), (F.floor(F.col("id") / 4) % REPEATS).cast("int").alias("rep"), F.floor(F.col("id") / (4 * REPEATS)).cast("int").alias("pos"))
    return base.withColumn("idx", F.row_number().over(W.partitionBy("module_label", "rep").orderBy(((3 + F.col("rep")) * (F.col("pos") + 1)) % 17, "pos")) - 1)


def _placed(genes: DataFrame) -> DataFrame:
    return genes.withColumn("pos", F.floor(F.col("ord") / 4).cast("int"))


HALVES = f"""{SQL_SCHEDULE}, halves as (select module_label, rep, idx as pos, pos < 8 as is_first from sched),
hm as (select h.module_label, rep, sample_id, avg(case when is_first then sgn * z end) as a, avg(case when not is_first then sgn * z end) as b from halves h join mg on mg.module_label = h.module_label and mg.ord // 4 = h.pos where cohort = 'external' group by all),
hr as (select module_label, rep, {S.sql_corr('a', 'b')} as r from hm group by module_label, rep)"""


@query(f"with {S.SQL_EXPRESSION}, {HALVES} select module_label, {r('median(r)', 'split_half_median')}, {r('quantile_cont(r, 0.05)', 'split_half_q05')}, {r('quantile_cont(r, 0.95)', 'split_half_q95')}, count(r)::bigint as split_half_valid_repeats, {r('avg(cast(r > 0 as int))', 'split_half_fraction_positive')} from hr where r is not null group by module_label")
def split_half(spark, sf_dir):
    """Reliability of the signed mean over random halves of the genes."""
    genes = _placed(_genes(spark, sf_dir).filter("cohort = 'external'"))
    return tidy(resampling.split_half_summary(resampling.split_half(genes, _schedule(spark))))


LOO = f"""
tot as (select *, sgn * z as t, sum(sgn * z) over (partition by cohort, module_label, sample_id) as total, count(*) over (partition by cohort, module_label, sample_id) as n from mg),
loo as (select cohort, module_label, gene, max(n - 1) as left_over, {S.sql_corr('total / n', '(total - t) / (n - 1)')} as r from tot group by cohort, module_label, gene)"""


@query(f"with {S.SQL_EXPRESSION}, {LOO} select cohort, module_label, gene, left_over::bigint as n_genes_remaining, {r('r', 'correlation_with_full_score')} from loo")
def gene_leave_one_out(spark, sf_dir):
    """Correlation of the score with itself without each gene."""
    return tidy(resampling.leave_one_out(_genes(spark, sf_dir)))


@query(f"with {S.SQL_EXPRESSION}, {LOO} select cohort, module_label, {r('min(r)', 'minimum_gene_loo_correlation')}, {r('median(r)', 'median_gene_loo_correlation')} from loo group by cohort, module_label")
def leave_one_out_summary(spark, sf_dir):
    return tidy(resampling.leave_one_out_summary(resampling.leave_one_out(_genes(spark, sf_dir))))


PERMUTED = f"""o as (select module_label, {S.sql_corr('re', 'rf')} as obs, abs(sum(re * rf)) as bound from rk group by module_label),
n as (select s.module_label, s.rep, abs(sum(e.re * f.rf)) as v from sched s join rk e on e.module_label = s.module_label and e.pos = s.idx join rk f on f.module_label = s.module_label and f.pos = s.pos group by s.module_label, s.rep)"""


@query(f"""with {S.SQL_EXPRESSION}, {SQL_SCHEDULE}, ld as (select module_label, ord // 4 as pos, avg(case when cohort = 'external' then z * z * z end) as e, max(loading) as f from mg group by module_label, ord),
rk as (select module_label, pos, {S.sql_rank('e', 'module_label')} - cast(8.5 as double) as re, {S.sql_rank('f', 'module_label')} - cast(8.5 as double) as rf from ld), {PERMUTED}
select module_label, {r('max(obs)', 'observed')}, count(*)::bigint as n_permutations, count(case when v >= bound then 1 end)::bigint as extreme_count, {r('(count(case when v >= bound then 1 end) + 1) / (count(*) + cast(1 as double))', 'p_value')} from n join o using (module_label) group by module_label""")
def loading_permutation(spark, sf_dir):
    """Permutation test of loadings (here: the genes' third moments) under a stored schedule."""
    genes = _placed(_genes(spark, sf_dir))
    pairs = genes.groupBy("module_label", "pos").agg(F.avg(F.when(F.col("cohort") == "external", F.col("z") * F.col("z") * F.col("z"))).alias("external"), F.max("loading").alias("frozen"))
    return tidy(resampling.loading_permutation(pairs, _schedule(spark)))


@query(f"""with {S.SQL_EXPRESSION}, {EDGES}, {SQL_SCHEDULE}, re0 as (select module_label, i // 4 as i, j // 4 as j, rr - cast(60.5 as double) as rr, re - cast(60.5 as double) as re from ranked_edges),
o as (select module_label, {S.sql_corr('rr', 're')} as obs, abs(sum(rr * re)) as bound from re0 group by module_label),
n as (select a.module_label, p.rep, abs(sum(a.rr * b.re)) as v from re0 a join sched p on p.module_label = a.module_label and p.pos = a.i join sched q on q.module_label = a.module_label and q.rep = p.rep and q.pos = a.j
  join re0 b on b.module_label = a.module_label and b.i = least(p.idx, q.idx) and b.j = greatest(p.idx, q.idx) group by a.module_label, p.rep)
select module_label, {r('max(obs)', 'observed')}, count(*)::bigint as n_permutations, count(case when v >= bound then 1 end)::bigint as extreme_count, {r('(count(case when v >= bound then 1 end) + 1) / (count(*) + cast(1 as double))', 'p_value')} from n join o using (module_label) group by module_label""")
def edge_permutation(spark, sf_dir):
    """Gene label permutation test of edge preservation under a stored schedule."""
    edges = preservation.edges(_placed(_genes(spark, sf_dir)).withColumn("ord", F.col("pos")))
    return tidy(resampling.edge_permutation(edges, _schedule(spark), "reference", "external"))


# ---- localisation -----------------------------------------------------------------------------------

BULK = "bulk as (select donor, cell_type, count(*) as n_cells, avg(value) as mean, median(value) as median from cells group by donor, cell_type having count(*) >= 10)"


def _bulk(spark, sf_dir):
    return localization.pseudobulk(S.cells(spark, sf_dir), "value", ["donor", "cell_type"], 10)


@query(f"with {S.SQL_CELLS}, {BULK} select donor::bigint as donor, cell_type, n_cells::bigint as n_cells, {r('mean', 'mean')}, {r('median', 'median')} from bulk")
def pseudobulk(spark, sf_dir):
    return tidy(_bulk(spark, sf_dir))


@query(f"with {S.SQL_CELLS}, {BULK} select cell_type, count(distinct donor)::bigint as n_donors, sum(n_cells)::bigint as n_cells, {r('median(mean)', 'median')}, {r('avg(mean)', 'mean')}, {r('quantile_cont(mean, 0.25)', 'q25')}, {r('quantile_cont(mean, 0.75)', 'q75')}, {r('min(mean)', 'minimum')}, {r('max(mean)', 'maximum')} from bulk group by cell_type having count(distinct donor) >= 3")
def cell_type_summary(spark, sf_dir):
    return tidy(localization.cell_type_summary(_bulk(spark, sf_dir), "donor", "cell_type", 3))


@query(f"""with {S.SQL_CELLS}, {BULK}, wo as (select l.donor as lft, cell_type, avg(mean) as m from bulk join (select distinct donor from bulk) l on bulk.donor != l.donor group by all), wr as (select *, row_number() over (partition by lft order by m desc, cell_type) as k from wo),
fl as (select cell_type, row_number() over (order by avg(mean) desc, cell_type) as full_rank from bulk group by cell_type)
select cell_type, max(full_rank)::bigint as full_rank, min(k)::bigint as best_rank, max(k)::bigint as worst_rank, {r('median(k)', 'median_rank')}, max(abs(k - full_rank))::bigint as largest_change from wr join fl using (cell_type) group by cell_type""")
def rank_stability(spark, sf_dir):
    """Rank of each cell type without each donor in turn."""
    return tidy(localization.rank_stability(_bulk(spark, sf_dir), "donor", "cell_type"))


@query(f"""with {S.SQL_CELLS}, {BULK}, types as (select min(cell_type) as a, max(cell_type) as b from bulk), d as (select donor, max(case when cell_type = a then mean end) - max(case when cell_type = b then mean end) as d from bulk, types group by donor),
dd as (select d, row_number() over (order by d) - 1 as i from d where d is not null), n as (select count(*) as n, abs(avg(d)) as obs from dd), k as (select unnest(range(cast(pow(2, (select n from n)) as bigint))) as k),
m as (select k, avg(case when floor(k / pow(2, i)) % 2 = 1 then -d else d end) as m from k, dd group by k)
select {r('avg(cast(abs(m) >= obs - 1e-12 as int))', 'p_value')}, max(n)::bigint as n_pairs from m, n""")
def sign_flip(spark, sf_dir):
    """Exact sign-flip test of the donors' differences between two cell types."""
    bulk = _bulk(spark, sf_dir)
    ends = bulk.agg(F.min("cell_type").alias("_x"), F.max("cell_type").alias("_y"))
    marked = bulk.crossJoin(F.broadcast(ends)).withColumn("cell_type", F.when(F.col("cell_type") == F.col("_x"), "a").when(F.col("cell_type") == F.col("_y"), "b"))
    return tidy(resampling.sign_flip(localization.paired_differences(marked, "donor", "cell_type", "a", "b").withColumn("all", F.lit(1)), "difference", "all").select("p_value", "n_pairs"))


@query(f"with {S.SQL_CELLS}, m as (select donor, cell_type, count(*) as n, avg(value) as m from cells group by all having count(*) >= 10) select donor::bigint as donor, arg_max(cell_type, m) as top_type, {r('max(m)', 'top_mean')}, {r('max(m) - min(m)', 'specificity_range')}, count(*)::bigint as n_types from m group by donor")
def localisation(spark, sf_dir):
    """Type with the highest mean (of each donor as the stand-in for genes)."""
    return tidy(localization.gene_localisation(S.cells(spark, sf_dir), "donor", "cell_type", "value", 10))


# ---- outcomes ---------------------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))


SQL_LABELLED = "lab as (select doc_id, lang, cast(n_chars as double) as score, quality as y from documents join labels using (doc_id))"


@query(f"with {SQL_LABELLED}, k as (select lang, y, {S.sql_rank('score', 'lang')} as k from lab) select lang, sum(y)::bigint as n_positive, sum(1 - y)::bigint as n_negative, {r('(sum(k * y) - sum(y) * (sum(y) + 1) / cast(2 as double)) / nullif(sum(y) * sum(1 - y), 0)', 'auc')} from k group by lang")
def roc_auc(spark, sf_dir):
    return tidy(outcomes.roc_auc(_labelled(spark, sf_dir), "score", "y", "lang"))


@query(f"with {SQL_LABELLED}, s as (select lang, score, count(*) as n, sum(y) as tp from lab group by lang, score), c as (select *, sum(n) over w as cn, sum(tp) over w as ct from s window w as (partition by lang order by score desc)) select lang, {r('sum(tp * ct / cast(cn as double)) / nullif(sum(tp), 0)', 'average_precision')} from c group by lang")
def average_precision(spark, sf_dir):
    return tidy(outcomes.average_precision(_labelled(spark, sf_dir), "score", "y", "lang"))


@query(f"with {S.SQL_SURVIVAL} select count(*)::bigint as n_pairs, {r('avg(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end)', 'c_index')} from surv a join surv b on a.time < b.time and a.event = 1")
def concordance(spark, sf_dir):
    """Harrell's C over comparable pairs of a cohort."""
    return tidy(outcomes.concordance(S.survival(spark, sf_dir).withColumn("cohort", F.lit("all")), "time", "event", "score", "cohort").drop("cohort"))


@query(f"""with {SQL_LABELLED}, k as (select lang, y, {S.sql_rank('score', 'lang')} as k, count(*) over (partition by lang, score) as c from lab), s as (select lang, cast(sum(y) as double) as n1, cast(sum(1 - y) as double) as n2, sum(k * y) as w, cast(sum(c * c - 1) as double) as ties from k group by lang),
u as (select *, w - n1 * (n1 + 1) / 2 as u, n1 + n2 as n from s), z as (select *, greatest(0, abs(u - n1 * n2 / 2) - 0.5) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 0) as z from u), t as (select *, 1 / (1 + cast(0.2316419 as double) * z) as t from z)
select lang, {r('u', 'u')}, {r('least(1, 2 * exp(-z * z / 2) * cast(0.3989422804014327 as double) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))', 'p_value')} from t""")
def mann_whitney(spark, sf_dir):
    return tidy(outcomes.mann_whitney(_labelled(spark, sf_dir), "score", "y", "lang"))


@query(f"""with {S.SQL_EXPRESSION}, p as (select cohort, sample_id, max(case when gene = 'G0' then value end) as y, max(case when gene = 'G1' then value end) as x from raw_expr group by cohort, sample_id),
s as (select *, covar_samp(x, y) over w / nullif(var_samp(x) over w, 0) as slope, avg(x) over w as mx, avg(y) over w as my from p window w as (partition by cohort)), q as (select cohort, sample_id, y - (my + slope * (x - mx)) as e from s)
select cohort, sample_id, {r('(e - avg(e) over w) / nullif(stddev_samp(e) over w, 0)', 'residual')} from q window w as (partition by cohort)""")
def residual(spark, sf_dir):
    """A gene without the part that another explains."""
    p = S.expression(spark, sf_dir).groupBy("cohort", "sample_id").agg(F.max(F.when(F.col("gene") == "G0", F.col("value"))).alias("y"), F.max(F.when(F.col("gene") == "G1", F.col("value"))).alias("x"))
    return tidy(outcomes.residual(p, "y", "x", "cohort").select("cohort", "sample_id", "residual"))


@query(f"with {S.SQL_P_VALUES} select family, count(p_value)::bigint as n_folds, {r('avg(p_value)', 'mean')}, {r('median(p_value)', 'median')}, {r('min(p_value)', 'minimum')}, {r('max(p_value)', 'maximum')} from pv group by family")
def fold_summary(spark, sf_dir):
    return tidy(outcomes.fold_summary(S.p_values(spark, sf_dir), "p_value", "family"))


@query(f"with {S.SQL_P_VALUES}, t as (select family, count(p_value) as n, avg(p_value - 0.3) as d, sqrt((1 / cast(count(p_value) as double) + 1 / cast(4 as double)) * var_samp(p_value - 0.3)) as se from pv group by family) select family, n::bigint as n, {r('d', 'mean_difference')}, {r('d / nullif(se, 0)', 't')} from t")
def corrected_t(spark, sf_dir):
    return tidy(outcomes.corrected_t(S.p_values(spark, sf_dir).withColumn("d", F.col("p_value") - 0.3), "d", 5, "family").drop("p_value"))


# ---- bins, ranks, sets ------------------------------------------------------------------------------


@query(f"""with {S.SQL_P_VALUES}, e as (select family, list_distinct([quantile_cont(p_value, 0.0), quantile_cont(p_value, 0.2), quantile_cont(p_value, 0.4), quantile_cont(p_value, 0.6), quantile_cont(p_value, 0.8), quantile_cont(p_value, 1.0)]) as e from pv group by family)
select p_partkey, family, len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: x < p_value))::bigint as bin from pv join e using (family) where p_value is not null""")
def quantile_bins(spark, sf_dir):
    """Right-closed quintiles within families."""
    return tidy(stats.quantile_bins(S.p_values(spark, sf_dir), "p_value", 5, "family").filter("bin is not null").select("p_partkey", "family", "bin"))


@query(f"with {S.SQL_P_VALUES}, k as (select p_partkey, family, {S.sql_rank('p_value', 'family')} / count(*) over (partition by family) as share from pv where p_value is not null) select p_partkey, {r('share', 'share')}, least(floor(share * 10), 9)::bigint as bin from k")
def rank_bins(spark, sf_dir):
    """Average rank as a share, in ten floor bins."""
    p = S.p_values(spark, sf_dir).filter("p_value is not null").withColumn("share", stats.percent_rank_average("p_value", "family"))
    return tidy(p.select("p_partkey", "share", stats.floor_bins(F.col("share"), 10).alias("bin")))


@query()
def rank_gaussian(spark, sf_dir):
    """Normal scores within families."""
    return tidy(stats.rank_gaussian(S.p_values(spark, sf_dir), "p_value", "family").select("p_partkey", "gaussian"))


@query(f"""with a as (select distinct p_brand as a, p_size as item from part), b as (select distinct p_type as b, p_size as item from part), o as (select a, b, count(*) as n_overlap from a join b using (item) group by a, b),
x as (select o.*, (select count(*) from a z where z.a = o.a) as n_a, (select count(*) from b z where z.b = o.b) as n_b from o), f as (select *, 2 * n_overlap / cast(n_a + n_b as double) as f1 from x), k as (select *, row_number() over (partition by a order by f1 desc, n_overlap desc, b) as k from f)
select a, b, n_overlap::bigint as n_overlap, {r('n_overlap / cast(n_a + n_b - n_overlap as double)', 'jaccard')}, {r('f1', 'f1')}, {r('n_overlap / cast(n_a as double)', 'recall')}, {r('n_overlap / cast(n_b as double)', '"precision"')} from k where k = 1""")
def best_overlap(spark, sf_dir):
    """The set that matches each set best (brands and types over sizes)."""
    p = S.table(spark, sf_dir, "part")
    found = sets.overlap(p.select(F.col("p_brand").alias("a"), F.col("p_size").alias("item")), p.select(F.col("p_type").alias("b"), F.col("p_size").alias("item")), "a", "b", "item")
    return tidy(sets.best_match(found, "a", "b").select("a", "b", "n_overlap", "jaccard", "f1", "recall", "precision"))


# ---- verification, provenance, inventory ------------------------------------------------------------


@query(f"""with {S.SQL_P_VALUES}, e as (select * from pv where p_partkey % 10 != 0), o as (select p_partkey, case when p_partkey % 7 = 0 then p_value + 1e-6 else p_value end as p_value from pv where p_partkey % 11 != 0),
c as (select coalesce(e.p_partkey, o.p_partkey) as k, e.p_partkey is null or o.p_partkey is null as one, e.p_value as a, o.p_value as b from e full join o on e.p_partkey = o.p_partkey)
select 'p_value' as metric, count(*)::bigint as n_rows, count(case when one or not (case when a is null and b is null then true when a is null or b is null then false else abs(b - a) <= 1e-10 + 1e-8 * abs(a) end) then 1 end)::bigint as n_mismatches, count(case when one then 1 end)::bigint as n_one_sided, {r('max(abs(b - a))', 'max_abs_difference')}, false as passed from c""")
def verification(spark, sf_dir):
    """Full outer comparison of two result tables with tolerances."""
    p = S.p_values(spark, sf_dir)
    other = p.filter("p_partkey % 11 != 0").withColumn("p_value", F.when(F.col("p_partkey") % 7 == 0, F.col("p_value") + 1e-6).otherwise(F.col("p_value")))
    return tidy(verify.verdict(verify.compared(p.filter("p_partkey % 10 != 0"), other, ["p_partkey"], ["p_value"])))


@query("select sha256(text) as sha256, count(*)::bigint as n, min(doc_id) as first_id, max(doc_id) as last_id from documents where text is not null group by sha256(text) having count(*) > 1")
def duplicate_content(spark, sf_dir):
    return verify.duplicate_content(S.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("select page_id, sha256(html) as sha256_plain, sha256(replace(replace(html, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) as sha256_crlf from pages")
def hash_forms(spark, sf_dir):
    return verify.hash_forms(S.table(spark, sf_dir, "pages"), "html").select("page_id", "sha256_plain", "sha256_crlf")


# A small keyword table of axes for the inventory queries.
AXES = [("licence", "license", 3.0), ("licence", "copyright", 2.0), ("contact", "@", 2.0), ("contact", "mail", 2.0), ("secret", "akia", 4.0), ("secret", "password", 3.0), ("secret", "token", 1.0), ("markup", "|", 1.0), ("markup", "###", 2.0)]
_AXIS_SQL = ", ".join("(" + " + ".join(f"case when contains(t, '{k}') then {w} else 0 end" for x, k, w in AXES if x == a) + f")::double as {a}" for a in sorted({x[0] for x in AXES}))
_AXIS_LONG = " union all ".join(f"select doc_id, '{a}' as axis, {a} as s from s" for a in sorted({x[0] for x in AXES}))


@query(f"with s as (select doc_id, {_AXIS_SQL} from (select doc_id, lower(coalesce(text, '')) as t from documents)), l as ({_AXIS_LONG}), b as (select *, max(s) over (partition by doc_id) as best from l) select doc_id, coalesce(string_agg(case when s >= greatest(2, least(4, best)) then axis end, ';' order by s desc, axis), '') as axes, max(best) as best_score from b group by doc_id")
def keyword_axes(spark, sf_dir):
    """Weighted keyword axes of each text."""
    table = spark.createDataFrame(AXES, "axis string, keyword string, weight double")
    return verify.axes(S.table(spark, sf_dir, "documents"), "doc_id", "text", table)


# Labelled line patterns for the inventory queries.
SIGNALS = {"address": "[a-z0-9]+@[a-z]+", "digits": "[0-9]{4}", "table": "[|]"}


@query("with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x from documents), s as (" + " union all ".join(f"select doc_id, '{k}' as label, count(*) as n from l where regexp_matches(x, '{v}') group by doc_id" for k, v in SIGNALS.items()) + ") select doc_id, label, n::bigint as n_lines from s")
def line_signals(spark, sf_dir):
    return verify.line_signals(S.table(spark, sf_dir, "documents"), "doc_id", "text", SIGNALS)


@query("with m as (select doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z]{4,}[0-9]+'))) as f from documents) select doc_id, len(f)::bigint as n_found, array_to_string(f, ';') as found from m")
def extracted(spark, sf_dir):
    """Sorted distinct matches of a pattern in each text."""
    return verify.extracted(S.table(spark, sf_dir, "documents"), "doc_id", "text", "[A-Z]{4,}[0-9]+")


@query("select p_brand, count(distinct p_type)::bigint as n, min(p_type) as first_name from part group by p_brand having count(distinct p_type) > 1")
def conflicts(spark, sf_dir):
    return verify.conflicts(S.table(spark, sf_dir, "part"), "p_brand", "p_type")


@query(f"with {S.SQL_P_VALUES} select p_partkey, cast(round(p_value * 100) as bigint) as k, {r('(cast(round(p_value * 100) as bigint) + 1) / cast(101 as double)', 'p')} from pv where p_value is not null")
def empirical_p(spark, sf_dir):
    """Empirical p from counts; the count is found again from p."""
    p = S.p_values(spark, sf_dir).filter("p_value is not null").withColumn("c", F.rint(F.round(F.col("p_value") * 100)).cast("bigint")).withColumn("p", stats.empirical_p(F.col("c"), 100))
    return tidy(p.select("p_partkey", verify.count_of_p(F.col("p"), 100).alias("k"), "p"))


# ---- recurrence and assay quality -------------------------------------------------------------------


@query()
def gene_modules(spark, sf_dir):
    """Genes clustered anew in each cohort."""
    from scoreloom.operators import recurrence

    _, z, _ = _z(spark, sf_dir)
    return tidy(recurrence.gene_modules(z, 0.02, 3))


@query(f"with {S.SQL_EXPRESSION}, {EDGES} select module_label, count(*)::bigint as n_edges, {r('avg(cast(sign(r_ref) = sign(r_ext) as int))', 'sign_concordance')} from both_edges where r_ref != 0 and r_ext != 0 group by module_label")
def sign_concordance(spark, sf_dir):
    """Share of edges with the same sign in both cohorts."""
    from scoreloom.operators import recurrence

    return tidy(recurrence.sign_concordance(preservation.edges(_genes(spark, sf_dir)), "reference", "external"))


@query(f"with {S.SQL_P_VALUES} select family, count(p_value)::bigint as n_null, {r('avg(cast(p_value <= 0.3 as int))', 'percentile')}, {r('(1 + count(case when p_value >= 0.3 then 1 end)) / (cast(1 as double) + count(p_value))', 'p_value')} from pv group by family")
def null_position(spark, sf_dir):
    """Where an observed value lies in its null distribution."""
    from scoreloom.operators import recurrence

    return tidy(recurrence.null_position(S.p_values(spark, sf_dir).withColumn("o", F.lit(0.3)), "p_value", "o", "family"))


SQL_PROBES = "pr as (select l_suppkey as probe, l_linenumber as sample, cast(l_quantity as double) as value, cast(l_discount as double) + 0.005 as det from lineitem)"


def _probes(spark, sf_dir):
    return S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("probe"), F.col("l_linenumber").alias("sample"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_discount").cast("double") + F.lit(0.005)).alias("det"))


@query(f"with {SQL_PROBES} select probe::bigint as probe, count(value)::bigint as n, {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, {r('var_samp(value)', 'variance')}, {r('stddev_samp(value)', 'sd')}, {r('median(det)', 'detection_median')}, {r('avg(det)', 'detection_mean')}, {r('avg(cast(det < 0.01 as int))', 'detected_01')}, {r('avg(cast(det < 0.05 as int))', 'detected_05')} from pr group by probe")
def probe_quality(spark, sf_dir):
    """Value and detection statistics of each probe."""
    from scoreloom.operators import recurrence

    return tidy(recurrence.probe_quality(_probes(spark, sf_dir), "probe", "value", "det"))


@query(f"with {SQL_PROBES} select sample::bigint as sample, count(*)::bigint as n_probes, count(case when det < 0.01 then 1 end)::bigint as n_detected_01, count(case when det < 0.05 then 1 end)::bigint as n_detected_05, {r('avg(cast(det < 0.01 as int))', 'share_01')}, {r('avg(cast(det < 0.05 as int))', 'share_05')} from pr group by sample")
def sample_quality(spark, sf_dir):
    """Detected probes of each sample."""
    from scoreloom.operators import recurrence

    return tidy(recurrence.sample_quality(_probes(spark, sf_dir), "sample", "det"))


@query(f"""with {S.SQL_CELLS}, {BULK}, v as (select row_number() over (order by donor, cell_type) - 1 as pos, mean from bulk), n as (select count(*) as n from v), s as (select rep, k, ((rep * 7 + 3) * (k * k + 1) + k) % n as idx from n, (select unnest(range(40)) as rep), (select pos as k from v)),
m as (select rep, avg(mean) as m from s join v on v.pos = s.idx group by rep) select count(m)::bigint as repeats, {r('quantile_cont(m, 0.025)', 'low')}, {r('quantile_cont(m, 0.975)', 'high')} from m""")
def bootstrap_interval(spark, sf_dir):
    """Percentile interval of a mean under a stored schedule."""
    v = _bulk(spark, sf_dir).withColumn("pos", F.row_number().over(W.orderBy("donor", "cell_type")) - 1).select("pos", "mean")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    s = v.select(F.col("pos").cast("bigint").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("rep")).crossJoin(F.broadcast(n))
    s = s.select("rep", F.col("k").alias("pos"), (((F.col("rep") * 7 + 3) * (F.col("k") * F.col("k") + 1) + F.col("k")) % F.col("n")).alias("idx"))
    return tidy(localization.bootstrap_interval(v, "mean", s))
