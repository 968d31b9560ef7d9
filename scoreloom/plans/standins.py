"""Stand-in inputs for the audit operators, made of the shared tables.

Expression: `embeddings`, a sample per vector, a gene per dimension, two cohorts by the parity of the
label. Weights: dimension % 4 is the module. P-value families: `part` by type. Donors x cell types:
`events`. Outcomes: `labels`. Survival: `orders`. Each has a SQL twin for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 2 == 0, "reference").otherwise("external").alias("cohort"), F.col("vec_id").cast("string").alias("sample_id"), F.posexplode("embedding").alias("gene_ord", "value"))
    return rows.select("cohort", "sample_id", F.concat(F.lit("G"), F.col("gene_ord").cast("string")).alias("gene"), "gene_ord", F.col("value").cast("double").alias("value"))


def weights(spark: SparkSession) -> DataFrame:
    d = F.col("id")
    return spark.range(GENES).select(F.concat(F.lit("M"), (d % 4).cast("string")).alias("module_label"), F.concat(F.lit("G"), d.cast("string")).alias("gene"), (((d * 37) % 101 - 50) / 50.0).alias("loading"), d.cast("int").alias("ord"))


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p-value for each part from its price's last digits; every 13th is missing."""
    part = table(spark, sf_dir, "part")
    cents = F.rint(F.col("p_retailprice") * 100).cast("bigint")
    p = F.when(F.col("p_partkey") % 13 == 0, None).otherwise((((cents * 7919 + F.col("p_partkey") * 104729) % 100003) + 1) / 100004.0)
    return part.select("p_partkey", F.col("p_type").alias("family"), F.pow(p, F.lit(2.0)).alias("p_value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("donor"), F.col("event_type").alias("cell_type"), "value")


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders: days to a fixed date, event, price."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("time"), (F.col("o_orderstatus") == "F").cast("int").alias("event"), F.col("o_totalprice").cast("double").alias("score"))


#: SQL twins of the above, as common table expressions.
SQL_EXPRESSION = """
raw_expr as (
  select case when label % 2 = 0 then 'reference' else 'external' end as cohort, cast(vec_id as varchar) as sample_id,
         d as gene_ord, 'G' || d as gene, cast(embedding[d + 1] as double) as value
  from embeddings, (select unnest(range(64)) as d)
), zs as (
  select cohort, sample_id, gene, gene_ord, (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as z
  from raw_expr window w as (partition by cohort, gene)
), wts as (
  select 'M' || (d % 4) as module_label, 'G' || d as gene, ((d * 37) % 101 - 50) / cast(50 as double) as loading, d as ord
  from (select unnest(range(64)) as d)
), mg as (
  select cohort, module_label, sample_id, w.gene, ord, loading, case when loading < 0 then -1 else 1 end as sgn, z
  from zs join wts w using (gene)
)"""
SQL_P_VALUES = """
pv as (
  select p_partkey, p_type as family,
         case when p_partkey % 13 = 0 then null else pow((((cast(round(p_retailprice * 100) as bigint) * 7919 + p_partkey * 104729) % 100003) + 1) / cast(100004 as double), 2) end as p_value
  from part
)"""
SQL_CELLS = """
cells as (select user_id % 6 as donor, event_type as cell_type, value from events)"""
SQL_SURVIVAL = """
surv as (
  select o_orderkey, cast(date_diff('day', cast(o_orderdate as date), date '1999-01-01') as double) as time, cast(o_orderstatus = 'F' as int) as event, cast(o_totalprice as double) as score
  from orders
)"""


def sql_corr(a: str, b: str) -> str:
    """Pearson correlation that is NULL for a constant side, as in the operators."""
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


def sql_rank(value: str, keys: str) -> str:
    """Average rank within keys."""
    return f"(rank() over (partition by {keys} order by {value}) + (count(*) over (partition by {keys}, {value}) - 1) / cast(2 as double))"
