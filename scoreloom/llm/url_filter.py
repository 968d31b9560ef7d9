"""URL filter: host and path rules looked up by short hash prefixes, confirmed by full digests.

Each distinct (identifier, url) is expanded into expressions, a suffix of its host's labels and a prefix of its
path, of the shapes that rules have. An equi-join on the first 4 bytes of the expressions' SHA-256 finds
rules; the full digest confirms them. Of the rules that fit, the one of the first list wins, then the longest
(host and path together, then the host; of two alike a block wins). Where none fits the verdict is the default.

Rules are sent to every task up to BROADCAST_RULES of them; more are joined by a shuffle in which common expressions (a hot host)
are salted. The verdicts come back by the urls' own key, so the pages are shuffled once.

Defined results: a null url, or one without '://', has an empty host and path, and no rule fits. Rows that
repeat are judged once and repeated at the end. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules (list, host, path, verdict) up to this many are sent to every task; a rule takes some 200 bytes.
BROADCAST_RULES = 100_000
#: Shares of a salted expression.
SALTS = 16
#: Distinct shapes of rules (labels of the host, characters of the path).
MOST_SHAPES = 1000
PREFIX = 8  # hexadecimal digits, 4 bytes

RULE_TYPE = "list int, host string, path string, verdict string"
#: Fixed rules of the registered query: list 0.
BASE_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The query's own list 1: hosts blocked where no rule of list 0 fits.
OWN_RULES = [("adult-x.example.org", "/", "block"), ("adult-x.example.net", "/", "block"), ("cheap-pills.example.org", "/", "block"), ("cheap-pills.example.net", "/", "block"), ("spam-farm.example.org", "/", "block"), ("spam-farm.example.net", "/", "block")]


def rules(spark: SparkSession, *lists: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from lists in the order of their precedence."""
    return spark.createDataFrame([(k, h.lower(), p, v) for k, one in enumerate(lists) for h, p, v in one], RULE_TYPE)


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, ASCII letters in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes(rule: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels of the host, characters of the path) of the rules: a small table, whatever the rules' number."""
    rows = rule.select(F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("chars")).distinct().limit(MOST_SHAPES + 1).collect()
    if len(rows) > MOST_SHAPES:
        raise ValueError(f"rules of more than {MOST_SHAPES} shapes")
    return sorted((r["labels"], r["chars"]) for r in rows)


def expressions(host: Column, path: Column, wanted: list[tuple[int, int]]) -> Column:
    """Array of the url's expressions: host suffix, a line break, path prefix, for each shape it is long enough for."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in wanted])
    n = F.size(F.split(host, "[.]"))
    able = F.filter(table, lambda s: (s["a"] <= n) & (s["b"] <= F.length(path)) & (host != ""))
    return F.transform(able, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["a"]), F.lit("\n"), F.substr(path, F.lit(1), s["b"])))


def judged(pages: DataFrame, rule: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salted: bool | None = None) -> DataFrame:
    """One row per page: identifier, host, path, verdict, and the winning rule with the number of its list (null: none).

    `rule` as made by `rules`. `salted` forces the way for many rules.
    """
    wanted = shapes(rule)
    keyed = rule.filter("host != ''").select("list", "host", "path", "verdict", F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("rule_digest"))
    keyed = keyed.withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX))
    single = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).groupBy("id", "url").agg(F.count(F.lit(1)).alias("n"))
    parts = single.select("id", "url", "n", host_of(F.col("url")).alias("url_host"), path_of(F.col("url")).alias("url_path"))
    if not wanted:
        parts = parts.withColumn("expression", F.lit(None).cast("string"))
    else:
        parts = parts.withColumn("expression", F.explode_outer(expressions(F.col("url_host"), F.col("url_path"), wanted)))
    asked = parts.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX)).drop("expression")
    many = rule.limit(BROADCAST_RULES + 1).count() > BROADCAST_RULES if salted is None else salted
    if many:
        keyed = keyed.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        found = asked.join(keyed.hint("merge"), (F.col("prefix") == F.col("rule_prefix")) & (F.col("salt") == F.col("rule_salt")), "left")
    else:
        found = asked.join(F.broadcast(keyed), F.col("prefix") == F.col("rule_prefix"), "left")
    # a shared prefix alone is no match
    rank = F.when(F.col("digest") == F.col("rule_digest"), F.struct((-F.col("list")).alias("r"), (F.length("host") + F.length("path")).alias("l"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), "host", "path", "verdict"))
    best = found.groupBy("id", "url", "n", "url_host", "url_path").agg(F.max(rank).alias("best"))
    rows = best.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return rows.select(F.col("id").alias(id_col), F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.concat("best.host", "best.path").alias("rule"), (-F.col("best.r")).alias("rule_list"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's url; the rule shown is one of the fixed list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = judged(pages, rules(spark, BASE_RULES, OWN_RULES))
    return found.select("page_id", "host", "path", F.when(F.col("rule_list") == 0, F.col("rule")).alias("rule"), "verdict")


OP11_SQL = f"""
with rules(list, host, path, verdict) as (
  values {', '.join(f"({k}, '{h}', '{p}', '{v}')" for k, one in enumerate((BASE_RULES, OWN_RULES)) for h, p, v in one)}
), u as (
  select page_id, row_number() over () as k, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages
), p as (
  select page_id, k, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
), f as (
  select k, arg_max(r.host || r.path, -1000000 * r.list + 1000 * (length(r.host) + length(r.path)) + length(r.host)) as rule, arg_max(r.list, -1000000 * r.list + 1000 * (length(r.host) + length(r.path)) + length(r.host)) as list,
    arg_max(r.verdict, -1000000 * r.list + 1000 * (length(r.host) + length(r.path)) + length(r.host)) as verdict
  from p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by k
)
select page_id, host, path, case when list = 0 then rule end as rule, coalesce(verdict, 'allow') as verdict from p left join f using (k)
"""
