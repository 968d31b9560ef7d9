"""Queries of regression models, with SQL twins that take Newton steps by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import models
from scoreloom.plans import standins as S
from scoreloom.plans.catalogue import SQL_LABELLED, _labelled, query, r, tidy


def sql_p(z: str) -> str:
    """Two-sided p of a normal z by the series of the error function, all terms positive."""
    x = f"(abs({z}) / sqrt(2.0::double))"
    term = f"exp(2 * erf_i * ln(2.0::double) + (2 * erf_i + 1) * ln(greatest({x}, 1e-300)) + lgamma(erf_i + 1) - lgamma(2 * erf_i + 2) - {x} * {x})"
    return f"case when {x} > 6 then 0.0::double else greatest(0.0::double, 1 - 2 / sqrt(pi()) * (select sum({term}) from range(0, 200) erf_t(erf_i))) end"


def ratio_columns(name: str) -> str:
    """Coefficient, ratio, interval and p of b and se."""
    return f"{r('b', 'coef')}, {r('exp(b)', name)}, {r('exp(b - 1.959963984540054::double * se)', 'ci_low')}, {r('exp(b + 1.959963984540054::double * se)', 'ci_high')}, {r(sql_p('b / se'), 'p_value')}"


# one evaluation at b: sums per time, running sums over later times, Efron's terms, then gradient, information and residuals
def sql_cox_sums(table: str) -> str:
    return f"""(select k, b, m, sum(x1 - t.mean) as g, sum(t.spread) as h, sum((x1 - t.mean) * rank) as u, sum(d * rank * rank) as v from (
    select *, total - sum(d) over later + (d + 1) / 2.0::double - (total + 1) / 2.0::double as rank, sum(s0) over later as r0, sum(s1) over later as r1, sum(s2) over later as r2 from (
      select it.k, it.b, it.m, z.time, sum(exp(it.b * x)) as s0, sum(exp(it.b * x) * x) as s1, sum(exp(it.b * x) * x * x) as s2, sum(event)::double as d, sum(sum(event)::double) over (partition by it.m) as total,
        sum(event * exp(it.b * x)) as q0, sum(event * exp(it.b * x) * x) as q1, sum(event * exp(it.b * x) * x * x) as q2, sum(event * x) as x1 from {table} it join z on z.m = it.m group by it.k, it.b, it.m, z.time
    ) window later as (partition by m order by time desc rows between unbounded preceding and current row)
  ), lateral (select sum((r1 - l / d * q1) / (r0 - l / d * q0)) as mean, sum((r2 - l / d * q2) / (r0 - l / d * q0) - pow((r1 - l / d * q1) / (r0 - l / d * q0), 2)) as spread from range(0, d::int) u(l)) t where d > 0 group by k, b, m)"""


@query(f"""with recursive {S.SQL_SURVIVAL}, f as (select *, cast(o_orderkey % 5 as varchar) as m from surv join orders using (o_orderkey)), z as (select m, time, event, (score - avg(score) over w) / stddev_samp(score) over w as x from f window w as (partition by m)),
it as (select 0 as k, m, 0.0::double as b from (select distinct m from z) union all select k + 1, m, b + g / h from {sql_cox_sums('it')} where k < 12),
last as (select * from it where k = 12), c as (select m, count(*) as n, sum(event) as events from z group by m)
select m as cohort, c.n::bigint as n, c.events::bigint as events, {ratio_columns('hazard_ratio')}, {r(sql_p('sqrt(events * pow(u / h, 2) / (1 / h * v))'), 'ph_p')}, '' as reason from (select *, sqrt(1 / h) as se from {sql_cox_sums('last')}) join c using (m)""")
def cox(spark, sf_dir):
    """Hazard model of all orders' prices, in five cohorts."""
    rows = S.survival(spark, sf_dir).withColumn("cohort", (F.col("o_orderkey") % 5).cast("string"))
    return tidy(models.cox(rows, "time", "event", "score", "cohort"))


# one IRLS evaluation at (b, a)
def sql_logistic_sums(table: str) -> str:
    return f"""(select k, lang, b, a, sum((y - p) * x) as g1, sum(y - p) as g0, sum(p * (1 - p) * x * x) as h11, sum(p * (1 - p) * x) as h10, sum(p * (1 - p)) as h00
    from (select it.*, z.x, z.y, 1 / (1 + exp(-(it.b * z.x + it.a))) as p from {table} it join z on z.lang = it.lang) group by k, lang, b, a)"""


@query(f"""with recursive {SQL_LABELLED}, z as (select lang, y, (score - avg(score) over w) / stddev_samp(score) over w as x from lab window w as (partition by lang)),
it as (select 0 as k, lang, 0.0::double as b, 0.0::double as a from (select distinct lang from z) union all
  select k + 1, lang, b + (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10), a + (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) from {sql_logistic_sums('it')} where k < 15),
last as (select * from it where k = 15), c as (select lang, count(*) as n, sum(y) as positives from z group by lang),
fit as (select lang, b, sqrt(h00 / (h11 * h00 - h10 * h10)) as se from {sql_logistic_sums('last')}), s as (select *, case when n < 20 then 'too_few_rows' when least(positives, n - positives) < 5 then 'too_few_of_a_class' else '' end as reason from c)
select lang, n::bigint as n, positives::bigint as positives, (n - positives)::bigint as negatives, case when reason = '' then coef end as coef, case when reason = '' then odds_ratio end as odds_ratio, case when reason = '' then ci_low end as ci_low, case when reason = '' then ci_high end as ci_high, case when reason = '' then p_value end as p_value, reason
from s join (select lang, {ratio_columns('odds_ratio')} from fit) using (lang)""")
def logistic(spark, sf_dir):
    """Quality against length, per language."""
    return tidy(models.logistic(_labelled(spark, sf_dir), "y", "score", "lang"))
