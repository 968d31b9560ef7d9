"""Mixing sources to target weights by a low-discrepancy schedule.

Only DataFrame functions. Sources, in code point order with null last, weigh `weights` in turn and share
`share` times all words; a target stops at `most` times its source's size and the excess goes to the
others by weight. That fixed point is found in one pass over the sources ordered by size per weight.

A source's blocks are of one size: its target's FINE-th part, between 1 word and the mix's own size (its words over
`slots`, BLOCK at most, so that blocks don't grow with the corpus). So a small source has small blocks. Its target asks for so many slots.
Slot k has the point frac(k * g), g the golden ratio's fraction; the cumulative shares of slots asked for map
the point to a source. Such points fall into every interval in proportion to its length with a logarithmic
error, so each source's slots are spread evenly. The sequence goes on to AHEAD times the slots asked for, so that every source has
enough; it takes the first ones it asked for, and its words are within a block of the target. The r-th slot
of a source takes the r-th block of its stream of shuffled documents; after the last block the stream
starts again, `most` times at the most. Blocks are cut by words, so a document may be taken in part.

Rows without an identifier are shuffled by a hash of their text.

Sizes: nothing is ranked or summed over a whole source in one task. Documents are dealt by source and
hash range (4096 ranges), slots by source and stretch of 4096; only a row per range or stretch meets in
a window over its source. Only the number of slots comes to the driver.

Defined results: null text has size 0 and is never taken; a null source is a source of its own; equal
rows are taken alike up to a block; an empty table gives an empty result. Columns of the input other than
those named pass only in `mixed_rows`; own columns start with `_m_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, words

GOLDEN = 0.6180339887498949
#: No block has more words than this.
BLOCK = 1024
#: Slots are numbered by two digits of this base, so that points keep their precision for large numbers.
DIGIT = 1 << 20
STRETCH = 4096
CELLS = 4096
#: A source's blocks are this part of its target at the most.
FINE = 1024
#: Points of the sequence for each slot asked for.
AHEAD = 2
BEFORE = (W.unboundedPreceding, -1)


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, slots: int) -> DataFrame:
    """One row per source: _m_key, _m_total, _m_target, words of a block, slots asked for, and its interval of their shares [_m_lo, _m_hi)."""
    per = sized.groupBy("_m_key").agg(F.sum("_m_size").alias("_m_total"), F.count(F.lit(1)).alias("_m_docs"))
    order, everything = W.orderBy("_m_key"), W.partitionBy()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_m_weight", F.get(turn, (F.row_number().over(order) - 1) % len(weights)))
    per = per.withColumns({"_m_cap": most * F.col("_m_total").cast("double"), "_m_all": share * F.sum("_m_total").over(everything)})
    fill = W.orderBy(F.col("_m_cap") / F.col("_m_weight"), "_m_key")
    left = F.col("_m_all") - F.coalesce(F.sum("_m_cap").over(fill.rowsBetween(*BEFORE)), F.lit(0.0))
    weight_left = F.sum("_m_weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    per = per.withColumn("_m_full", F.col("_m_cap") / F.col("_m_weight") <= left / weight_left)
    rest = F.col("_m_all") - F.coalesce(F.sum(F.when(F.col("_m_full"), F.col("_m_cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_m_full"), F.col("_m_weight"))).over(everything)
    per = per.withColumn("_m_target", F.when(F.col("_m_full"), F.col("_m_cap")).otherwise(F.col("_m_weight") * rest / open_weight))
    own = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.ceil(F.col("_m_all") / slots)))
    per = per.withColumn("_m_size_of", F.least(own, F.greatest(F.lit(1), F.floor(F.col("_m_target") / FINE))).cast("bigint"))
    per = per.withColumn("_m_asked", F.ceil(F.col("_m_target") / F.col("_m_size_of")))
    part = F.col("_m_asked") / F.nullif(F.sum("_m_asked").over(everything), F.lit(0)).cast("double")
    lo = F.coalesce(F.sum(part).over(order.rowsBetween(*BEFORE)), F.lit(0.0))
    per = per.withColumns({"_m_part": part, "_m_lo": lo})
    last = F.row_number().over(W.orderBy((F.col("_m_part") > 0).desc_nulls_last(), F.col("_m_key").desc())) == 1
    return per.select("_m_key", "_m_total", "_m_target", "_m_size_of", "_m_asked", "_m_lo", F.when(last, F.lit(1.0)).otherwise(F.col("_m_lo") + F.col("_m_part")).alias("_m_hi"))


def schedule(targets: DataFrame, n_slots: int, most: int) -> DataFrame:
    """One row per slot that takes a block: slot, _m_key, rank, pass, _m_block."""
    spark = targets.sparkSession
    cells = targets.filter("_m_hi > _m_lo").withColumn("_m_cell", F.explode(F.sequence(F.floor(F.col("_m_lo") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("_m_hi") * CELLS)))))
    point = F.floor(F.col("slot") / DIGIT) * F.lit(DIGIT * GOLDEN % 1) + F.col("slot") % DIGIT * F.lit(GOLDEN)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("_m_u", point - F.floor(point)).withColumn("_m_cell", F.floor(F.col("_m_u") * CELLS))
    placed = slots.join(cells, "_m_cell").filter("_m_u >= _m_lo and _m_u < _m_hi").select("slot", "_m_key", "_m_total", "_m_size_of", "_m_asked", F.floor(F.col("slot") / STRETCH).alias("_m_stretch"))
    counts = placed.groupBy("_m_key", "_m_stretch").agg(F.count(F.lit(1)).alias("_m_n"))
    ahead = counts.select("_m_key", "_m_stretch", F.coalesce(F.sum("_m_n").over(W.partitionBy("_m_key").orderBy("_m_stretch").rowsBetween(*BEFORE)), F.lit(0)).alias("_m_ahead"))
    ranked = placed.join(ahead, ["_m_key", "_m_stretch"]).withColumn("rank", F.col("_m_ahead") + F.row_number().over(W.partitionBy("_m_key", "_m_stretch").orderBy("slot")) - 1)
    ranked = ranked.filter("rank < _m_asked")
    blocks = F.ceil(F.col("_m_total") / F.col("_m_size_of"))
    return ranked.withColumns({"pass": F.floor(F.col("rank") / blocks), "_m_block": F.col("rank") % blocks}).filter(F.col("pass") < most).select("slot", "_m_key", "rank", "pass", "_m_block")


def streams(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with its first word's place in its source's shuffled stream, `_m_at`."""
    dealt = sized.withColumn("_m_hash", F.md5(F.coalesce(F.col("_m_id").cast("string"), F.col("_m_salt"), F.lit("")).cast("binary"))).withColumn("_m_range", F.substring("_m_hash", 1, 3))
    sums = dealt.groupBy("_m_key", "_m_range").agg(F.sum("_m_size").alias("_m_sum"))
    sums = sums.withColumn("_m_ahead", F.coalesce(F.sum("_m_sum").over(W.partitionBy("_m_key").orderBy("_m_range").rowsBetween(*BEFORE)), F.lit(0)))
    sums = sums.join(targets.select("_m_key", "_m_total", "_m_target", "_m_size_of"), "_m_key").drop("_m_sum")
    inside = W.partitionBy("_m_key", "_m_range").orderBy("_m_hash", "_m_size")
    placed = dealt.withColumns({"_m_row": F.row_number().over(inside), "_m_in": F.coalesce(F.sum("_m_size").over(inside.rowsBetween(*BEFORE)), F.lit(0))})
    return placed.join(sums, ["_m_key", "_m_range"]).withColumn("_m_at", F.col("_m_ahead") + F.col("_m_in"))


def source_key(source: Column) -> Column:
    """Sorts as the sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, slots: int = 1 << 18) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    sized = materialise(df.select(F.col(id_col).alias("_m_id"), source_key(F.col(source_col).cast("string")).alias("_m_key"), F.size(words(F.col(text_col))).cast("bigint").alias("_m_size"), F.when(F.col(id_col).isNull(), F.md5(F.col(text_col).cast("binary"))).alias("_m_salt")), "sizes")
    targets = materialise(source_targets(sized, weights, share, most, slots), "targets")
    n_slots = AHEAD * int(targets.agg(F.sum("_m_asked")).first()[0] or 0)
    takes = schedule(targets, n_slots, most).groupBy("_m_key", "_m_block").agg(F.count(F.lit(1)).alias("_m_takes"))
    at, size, block = F.col("_m_at"), F.col("_m_size"), F.col("_m_size_of")
    placed = streams(sized, targets)
    pieces = placed.withColumn("_m_block", F.explode_outer(F.when(size > 0, F.sequence(F.floor(at / block), F.floor((at + size - 1) / block)))))
    held = F.least(at + size, (F.col("_m_block") + 1) * block) - F.greatest(at, F.col("_m_block") * block)
    taken = pieces.join(takes, ["_m_key", "_m_block"], "left").withColumn("_m_taken", F.coalesce(held * F.col("_m_takes"), F.lit(0)))
    done = taken.groupBy("_m_key", "_m_range", "_m_row").agg(*[F.first(c).alias(c) for c in ("_m_id", "_m_size", "_m_total", "_m_target")], F.sum("_m_taken").alias("_m_taken"))
    return done.select(F.col("_m_id").alias(id_col), F.col("_m_size").alias("size"), F.col("_m_total").alias("source_size"), F.col("_m_target").alias("target"), F.col("_m_taken").cast("bigint").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The input's rows and columns, each row as often as the mix takes it (its taken share rounded).

    Rows that share an identifier, or a text where that is null, share its mean; rows without words go. A
    document taken in part counts as taken wholly or not at all, whichever is nearer.
    """
    text = F.col(how.get("text_col", "text"))
    df_key = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), F.md5(text.cast("binary"))), F.lit(""))
    keyed = df.withColumn("_m_id", df_key)
    copies = mix(keyed, id_col="_m_id", **how).groupBy("_m_id").agg(F.floor(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0)) + F.lit(0.5)).cast("int").alias("_m_copies")).filter("_m_copies > 0")
    joined = keyed.join(copies, "_m_id")
    return joined.withColumn("_m_copy", F.explode(F.sequence(F.lit(1), "_m_copies"))).select(*df.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mix(documents(spark, sf_dir))


OP7_SQL = f"""
with sized as (
  select doc_id, coalesce('0' || source, '1') as k, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5(coalesce(doc_id::varchar, md5(text), '')) as h
  from documents
), per as (
  select k, cast(sum(size) as bigint) as total, (case (row_number() over (order by k) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w
  from sized group by k
), caps as (
  select *, 2 * total::double as cap, 1.5::double * sum(total) over () as budget from per
), filling as (
  select *, cap / w <= (budget - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, k rows between current row and unbounded following) as is_full
  from caps
), targets as (
  select k, total, budget, case when is_full then cap else w * (budget - coalesce(sum(case when is_full then cap end) over (), 0)) / sum(case when not is_full then w end) over () end as target
  from filling
), sized_blocks as (
  select *, least(least({BLOCK}, greatest(1, ceil(budget / {1 << 18}))), greatest(1, floor(target / {FINE})))::bigint as block from targets
), asking as (
  select *, ceil(target / block)::bigint as asked from sized_blocks
), shares as (
  select *, asked / nullif(sum(asked) over (), 0)::double as part from asking
), bounds as (
  select *, coalesce(sum(part) over (order by k rows between unbounded preceding and 1 preceding), 0) as lo,
         row_number() over (order by part > 0 desc nulls last, k desc) = 1 as is_last
  from shares
), slots as (
  select r.range * {GOLDEN!r}::double - floor(r.range * {GOLDEN!r}::double) as u
  from (select sum(asked)::bigint as n from asking), range(0, {AHEAD} * n) r
), slot_counts as (
  select b.k, least(count(*), max(asked)) as n from slots s join bounds b on s.u >= b.lo and s.u < (case when b.is_last then 1 else b.lo + b.part end) group by b.k
), placed as (
  select doc_id, s.k, size, coalesce(sum(size) over (partition by s.k order by h, size rows between unbounded preceding and 1 preceding), 0) as pos
  from sized s
)
select p.doc_id, p.size, t.total as source_size, t.target,
       cast(greatest(0, least(pos + p.size, least(total, coalesce(n, 0) * block)) - pos)
          + greatest(0, least(pos + p.size, least(total, greatest(0, coalesce(n, 0) - ceil(total::double / block)) * block)) - pos) as bigint) as taken
from placed p join asking t using (k) left join slot_counts c using (k)
"""
