"""Queries of null distributions, panels, profiles and exact rank tests, with their SQL twins.

Permutations and panels follow rules that both sides can state; programs here are the first 24 genes, candidates the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import inference, outcomes, panels, preservation, profiles, recurrence, scoring, stability, standardize
from scoreloom.plans import standins as S
from scoreloom.plans.catalogue import EDGES, SQL_SCHEDULE, _genes, _placed, _schedule, query, r, tidy
from scoreloom.sources.shared import written

PANELS = 40
GENES = 24

# ---- permuted labels --------------------------------------------------------------------------------


def sql_audit(name: str, totals: str, null: str) -> str:
    return f"""{name}_s as (select module_label, max(total / norm) as {name}_spearman, count(*)::bigint as {name}_permutations, (count(case when value >= total then 1 end) + 1) / (count(*) + 1::double) as {name}_p_positive, (count(case when abs(value) >= abs(total) then 1 end) + 1) / (count(*) + 1::double) as {name}_p_two_sided,
  avg(value / norm) as {name}_null_mean, quantile_cont(value / norm, 0.95) as {name}_null_q95 from {null} join {totals} using (module_label) group by module_label)"""


@query(f"""with {S.SQL_EXPRESSION}, {EDGES}, {SQL_SCHEDULE}, re0 as (select e.module_label, e.i // 4 as i, e.j // 4 as j, rr - 60.5::double as rr, re - 60.5::double as re, r_ref, r_ext from ranked_edges e join both_edges b on e.module_label = b.module_label and e.i = b.i and e.j = b.j),
et as (select module_label, sum(rr * re) as total, sqrt(sum(rr * rr) * sum(re * re)) as norm, {S.sql_corr('r_ref', 'r_ext')} as edge_pearson, avg(cast(sign(r_ref) = sign(r_ext) as int)) as edge_sign_concordance from re0 group by module_label),
en as (select a.module_label, p.rep, sum(a.rr * b.re) as value from re0 a join sched p on p.module_label = a.module_label and p.pos = a.i join sched q on q.module_label = a.module_label and q.rep = p.rep and q.pos = a.j
  join re0 b on b.module_label = a.module_label and b.i = least(p.idx, q.idx) and b.j = greatest(p.idx, q.idx) group by a.module_label, p.rep),
ld as (select module_label, ord // 4 as pos, avg(case when cohort = 'external' then z * z * z end) as e, max(loading) as f from mg group by module_label, ord),
rk as (select module_label, pos, sign(e) = sign(f) as same, {S.sql_rank('e', 'module_label')} - 8.5::double as re, {S.sql_rank('f', 'module_label')} - 8.5::double as rf from ld),
lt as (select module_label, sum(re * rf) as total, sqrt(sum(re * re) * sum(rf * rf)) as norm, avg(cast(same as int)) as loading_sign_concordance from rk group by module_label),
ln as (select module_label, rep, sum(a.re * b.rf) as value from sched join rk b using (module_label, pos) join rk a on a.module_label = sched.module_label and a.pos = sched.idx group by module_label, rep),
{sql_audit('edge', 'et', 'en')}, {sql_audit('loading', 'lt', 'ln')}
select module_label, {', '.join(r(f'{n}_{c}', f'{n}_{c}') for n in ('edge', 'loading') for c in ('spearman', 'p_positive', 'p_two_sided', 'null_mean', 'null_q95', 'sign_concordance'))}, {r('edge_pearson', 'edge_pearson')}, edge_permutations, loading_permutations
from edge_s join loading_s using (module_label) join et using (module_label) join lt using (module_label)""")
def cross_cohort_audit(spark, sf_dir):
    """Edges under permuted gene labels and loadings (here: third moments) under shuffling, by a stored schedule."""
    genes = _placed(_genes(spark, sf_dir))
    edges = written(preservation.edges_by_matrix(genes.withColumn("ord", F.col("pos"))), "edges")
    loadings = genes.groupBy("module_label", "pos").agg(F.avg(F.when(F.col("cohort") == "external", F.col("z") * F.col("z") * F.col("z"))).alias("external"), F.max("loading").alias("frozen"))
    return tidy(panels.cross_cohort_audit(edges, loadings, _schedule(spark), "reference", "external"))


# ---- panels -----------------------------------------------------------------------------------------


def _frozen(spark):
    return S.weights(spark).filter(F.col("ord") < GENES)


def _number(name: str = "gene"):
    return F.substring(name, 2, 9).cast("bigint")


def _drawn(spark, binned):
    m, p = F.substring("module_label", 2, 9).cast("bigint"), F.col("panel").cast("bigint")
    key = (_number() * (7919 + 31 * p) + p * 104729 + m * 613) % 100003
    return panels.whole_panels(panels.drawn_panels(binned, _frozen(spark), PANELS, key=key))


def _signed(spark, drawn):
    p = F.col("panel").cast("bigint")
    key = (_number("target") * (5003 + 17 * p) + p * 7877) % 100003
    return panels.signed_panels(drawn, _frozen(spark), key=key)


SQL_DRAWN = f"""
pw as (select * from wts where ord < {GENES}), tk as (select module_label, gene, ord, loading, bin, row_number() over (partition by module_label, bin order by ord) as k from pw join binned using (gene)),
ps as (select unnest(range({PANELS})) as panel),
ck as (select module_label, panel, gene, bin, key, row_number() over (partition by module_label, panel, bin order by key, gene) as k from (select module_label, panel, b.gene, b.bin, (g * (7919 + 31 * panel) + panel * 104729 + m * 613) % 100003 as key
  from (select module_label, substr(module_label, 2)::bigint as m from pw group by all), ps, (select gene, bin, substr(gene, 2)::bigint as g from binned where gene not in (select gene from pw)) b)),
hit as (select t.module_label, t.panel, t.gene as target, t.ord, c.gene from (select * from tk, ps) t left join ck c on c.module_label = t.module_label and c.panel = t.panel and c.bin = t.bin and c.k = t.k),
short as (select *, row_number() over (partition by module_label, panel order by ord) as n from hit where gene is null),
spare as (select module_label, panel, gene, row_number() over (partition by module_label, panel order by key, gene) as n from ck where not exists (select 1 from hit where hit.module_label = ck.module_label and hit.panel = ck.panel and hit.gene = ck.gene)),
drawn as (select module_label, panel, target, gene from hit where gene is not null union all select s.module_label, s.panel, s.target, f.gene from short s left join spare f using (module_label, panel, n)),
panel as (select * from drawn where (module_label, panel) not in (select (module_label, panel) from drawn where gene is null))"""


def sql_bins(value: str, n: int, source: str) -> str:
    """Quantile bins of a column over all rows of a table: inner edges below the value."""
    edges = ", ".join(f"quantile_cont({value}, {i / n})" for i in range(n + 1))
    return f"(select count(distinct e) from (select unnest([{edges}]) as e, min({value}) as lo, max({value}) as hi from {source}) where e > lo and e < hi and e < o.{value})"


SQL_EXPRESSION_BINS = f"gs as (select gene, avg(value) as m, stddev_samp(value) as s from raw_expr where cohort = 'external' group by gene), binned as (select gene, {sql_bins('m', 5, 'gs')} || '_' || {sql_bins('s', 5, 'gs')} as bin from gs o where s > 0)"
SQL_VARIABILITY_BINS = f"""gv as (select gene, var_samp(case when cohort = 'reference' then value end) as a, var_samp(case when cohort = 'external' then value end) as b from raw_expr group by gene),
gm as (select gene, ({S.sql_rank('a', '1')} + {S.sql_rank('b', '1')}) / 2.0::double / count(*) over () as m from gv), gk as (select gene, {S.sql_rank('m', '1')} as k from gm), binned as (select gene, {sql_bins('k', 5, 'gk')}::varchar as bin from gk o)"""


def sql_summary(reach: str) -> str:
    """The summary of `obs` (module_label, o) and `nul` (module_label, value), with q."""
    return f"""sm as (select module_label, max(o) as o, count(value) as n, avg(value) as a, median(value) as md, quantile_cont(value, 0.05) as q5, quantile_cont(value, 0.9) as q90, quantile_cont(value, 0.95) as q95, count(case when value <= o then 1 end) / count(value)::double as pc, (count(case when {reach} then 1 end) + 1) / (count(value) + 1::double) as p from obs left join nul using (module_label) group by module_label),
rq as (select *, p * count(*) over () / row_number() over (order by p, module_label) as raw, row_number() over (order by p, module_label) as k from sm)
select module_label, {r('o', 'observed')}, n::bigint as n_panels, {r('a', 'null_mean')}, {r('md', 'null_median')}, {r('q5', 'null_q05')}, {r('q90', 'null_q90')}, {r('q95', 'null_q95')}, {r('pc', 'percentile')}, {r('p', 'p_value')}, {r('least(1, min(raw) over (order by k rows between current row and unbounded following))', 'q_value')} from rq"""


@query(f"""with {S.SQL_EXPRESSION}, {SQL_VARIABILITY_BINS}, {SQL_DRAWN},
rows as (select 'own' as kind, module_label, 0 as panel, gene from pw union all select 'null', module_label, panel, gene from panel),
pc as (select x.kind, x.module_label, x.panel, x.gene as a, y.gene as b from rows x join rows y on x.kind = y.kind and x.module_label = y.module_label and x.panel = y.panel and x.gene < y.gene),
co as (select a.cohort, a.gene as a, b.gene as b, {S.sql_corr('a.z', 'b.z')} as r from zs a join zs b on a.cohort = b.cohort and a.sample_id = b.sample_id and a.gene < b.gene group by all),
pr as (select kind, module_label, panel, x.r as ra, y.r as rb from pc join co x on x.cohort = 'reference' and x.a = pc.a and x.b = pc.b join co y on y.cohort = 'external' and y.a = pc.a and y.b = pc.b),
rk as (select kind, module_label, panel, {S.sql_rank('ra', 'kind, module_label, panel')} as ka, {S.sql_rank('rb', 'kind, module_label, panel')} as kb from pr), sp as (select kind, module_label, panel, round({S.sql_corr('ka', 'kb')}, 12) as value from rk group by all),
obs as (select module_label, value as o from sp where kind = 'own'), nul as (select module_label, value from sp where kind = 'null'), {sql_summary('abs(value) >= abs(o)')}""")
def edge_panels(spark, sf_dir):
    """Edge preservation of each program among panels of equally variable genes."""
    expr = standardize.normalised(S.expression(spark, sf_dir))
    drawn = _drawn(spark, panels.variability_bins(expr, "reference", "external", 5))
    z = standardize.standardised(expr).select("cohort", "sample_id", "gene", F.col("z").alias("value"))
    found = written(panels.gene_correlations(z), "correlations")
    own = panels.panel_edges(_frozen(spark).withColumn("panel", F.lit(0)), found, "reference", "external")
    return tidy(panels.null_summary(own.select("module_label", F.col("value").alias("observed")), panels.panel_edges(drawn, found, "reference", "external"), magnitude=True))


SQL_SCORED = f"""
own as (select module_label, -1 as panel, gene, sgn from (select *, case when loading < 0 then -1 else 1 end as sgn from pw)),
st as (select p.module_label, p.panel, p.gene, row_number() over (partition by p.module_label, p.panel order by w.ord) as i, row_number() over (partition by p.module_label, p.panel order by (substr(p.target, 2)::bigint * (5003 + 17 * p.panel) + p.panel * 7877) % 100003, w.ord) as k, case when w.loading < 0 then -1 else 1 end as sgn from panel p join pw w on w.module_label = p.module_label and w.gene = p.target),
signed as (select * from own union all select a.module_label, a.panel, a.gene, b.sgn from st a join st b on a.module_label = b.module_label and a.panel = b.panel and b.k = a.i),
sc as (select module_label, panel, sample_id, avg(sgn * z) as score from signed join zs using (gene) where cohort = 'external' group by all)"""


def _scores(spark, sf_dir):
    """Signed means of the programs (panel -1) and of their panels in the external cohort."""
    expr = standardize.normalised(S.expression(spark, sf_dir))
    z = standardize.standardised(expr).filter("cohort = 'external'")
    drawn = _signed(spark, _drawn(spark, panels.expression_bins(expr.filter("cohort = 'external'"), 5)))
    own = _frozen(spark).select("module_label", F.lit(-1).alias("panel"), "gene", scoring.sign(F.col("loading")).alias("sgn"))
    return panels.signed_scores(z, drawn.select("module_label", "panel", "gene", "sgn").unionByName(own))


def _against_panels(found, value):
    own = found.filter("panel = -1").select("module_label", F.col(value).alias("observed"))
    return panels.null_summary(own, found.filter("panel >= 0").select("module_label", F.col(value).alias("value")))


@query(f"""with {S.SQL_EXPRESSION}, {SQL_EXPRESSION_BINS}, {SQL_DRAWN}, {SQL_SCORED}, {S.SQL_SURVIVAL}, ev as (select module_label, panel, time, event, round(sc.score, 9) as score from sc join surv on o_orderkey = sample_id::bigint),
ci as (select module_label, panel, avg(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end) as value from ev a join ev b using (module_label, panel) where a.time < b.time and a.event = 1 group by all),
obs as (select module_label, value as o from ci where panel = -1), nul as (select module_label, value from ci where panel >= 0), {sql_summary('value >= o')}""")
def concordance_panels(spark, sf_dir):
    """Concordance of each program with survival among panels of equal mean and spread, their signs permuted; all panels in one count."""
    ends = S.survival(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("sample_id"), "time", "event")
    rows = written(_scores(spark, sf_dir).withColumn("score", F.round("score", 9)).join(ends, "sample_id"), "scores")
    return tidy(_against_panels(outcomes.concordance(rows, "time", "event", "score", "module_label", "panel"), "c_index"))


@query(f"""with {S.SQL_EXPRESSION}, {SQL_EXPRESSION_BINS}, {SQL_DRAWN}, {SQL_SCORED}, ev as (select module_label, panel, label % 4 = 1 as y, round(score, 9) as score from sc join embeddings on vec_id = sample_id::bigint), rk as (select *, {S.sql_rank('score', 'module_label, panel')} as k from ev),
au as (select module_label, panel, (sum(case when y then k else 0 end) - count(case when y then 1 end) * (count(case when y then 1 end) + 1) / 2.0::double) / nullif(count(case when y then 1 end) * count(case when not y then 1 end), 0) as value from rk group by all),
obs as (select module_label, value as o from au where panel = -1), nul as (select module_label, value from au where panel >= 0), {sql_summary('value >= o')}""")
def panel_null(spark, sf_dir):
    """AUC of each program for the label among panels of equal mean and spread, their signs permuted."""
    y = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), (F.col("label") % 4 == 1).cast("int").alias("y"))
    rows = written(_scores(spark, sf_dir).withColumn("score", F.round("score", 9)).join(y, "sample_id"), "scores")
    return tidy(_against_panels(outcomes.roc_auc(rows, "score", "y", "module_label", "panel"), "auc"))


@query()
def rediscovery_null(spark, sf_dir):
    """Frozen modules among found ones, against panels of equally variable genes."""
    expr = standardize.normalised(S.expression(spark, sf_dir))
    z = standardize.standardised(expr)
    found = recurrence.gene_modules(z.filter("cohort = 'external'"), 0.02, 3).filter("module_id > 0").select(F.col("module_id").cast("string").alias("module"), "gene")
    drawn = _drawn(spark, panels.variability_bins(expr, "reference", "external", 5))
    return tidy(stability.rediscovery_null(found, _frozen(spark).select("module_label", "gene"), drawn.select("module_label", "panel", "gene")))


# ---- profiles and exact rank tests ------------------------------------------------------------------


@query(f"""with {S.SQL_EXPRESSION}, c as (select cohort, sample_id, gene, value - avg(value) over (partition by cohort, gene) as c, {S.sql_rank('value', 'cohort, sample_id')} as k from raw_expr),
p as (select a.sample_id as sample, b.sample_id as nearest, round({S.sql_corr('a.k', 'b.k')}, {profiles.DIGITS}) as kr, round({S.sql_corr('a.c', 'b.c')}, {profiles.DIGITS}) as cr from c a join c b on a.gene = b.gene and a.cohort = 'external' and b.cohort = 'reference' group by all),
t as (select *, first_value(nearest) over (partition by sample order by kr desc nulls last, nearest) as nk, first_value(nearest) over (partition by sample order by cr desc nulls last, nearest) as nc from p)
select sample, {r('max(kr)', 'maximum_rank_r')}, max(nk) as nearest_by_rank, {r('max(cr)', 'maximum_centred_r')}, max(nc) as nearest_by_centred, max(cast(kr >= 0.995 or cr >= 0.98 or (kr >= 0.985 and cr >= 0.9) as int)) = 1 as suspect from t group by sample""")
def profile_neighbours(spark, sf_dir):
    """Nearest profile of every external sample in the other cohort."""
    return tidy(profiles.profile_neighbours(S.expression(spark, sf_dir), "reference", "external"))


@query(f"""with recursive {S.SQL_P_VALUES}, d as (select p_partkey, family || '/' || p_partkey % 11 as family, p_value - 0.3 as d, abs(p_value - 0.3) as a from pv where p_value is not null and p_value != 0.3), k as (select *, {S.sql_rank('a', 'family')} as k, count(*) over (partition by family, a)::double as t, row_number() over (partition by family order by a, p_partkey) as i, count(*) over (partition by family) as n from d),
ways as (select family, 0::bigint as i, 0::bigint as s, 1.0::double as c from k group by family union all
  select w.family, w.i + 1, w.s + case when side = 1 then (2 * k.k)::bigint else 0 end, sum(w.c) from ways w join k on k.family = w.family and k.i = w.i + 1 and k.n <= 50, (values (0), (1)) v(side) group by all),
s as (select family, count(*) as n, sum(case when d > 0 then k else 0 end) as w, sum(t * t - 1) as ties from k group by family), z as (select *, (w - n * (n + 1) / 4::double) / nullif(sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) as z from s), x as (select *, 1 / (1 + 0.2316419::double * abs(z)) as t from z),
y as (select *, exp(-z * z / 2) * 0.3989422804014327::double * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) as tail from x),
e as (select y.family, sum(case when s >= 2 * w then c else 0 end) / pow(2, n) as above, sum(case when s <= 2 * w then c else 0 end) / pow(2, n) as below from y join ways on ways.family = y.family and ways.i = n group by y.family, n)
select family, n::bigint as n, {r('w', 'w_plus')}, {r('case when n <= 50 then least(1, 2 * least(above, below)) else least(1, 2 * tail) end', 'p_two_sided')}, {r('case when n <= 50 then above when z >= 0 then tail else 1 - tail end', 'p_greater')} from y left join e using (family)""")
def signed_rank(spark, sf_dir):
    """Wilcoxon signed-rank test within parts of families, exact for small ones."""
    p = S.p_values(spark, sf_dir).withColumn("family", F.concat_ws("/", "family", (F.col("p_partkey") % 11).cast("string")))
    return tidy(inference.signed_rank(p.withColumn("d", F.col("p_value") - 0.3), "d", "family"))
