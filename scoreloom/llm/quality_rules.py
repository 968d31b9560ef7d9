"""Quality rules: counts of a text's words, symbols and repetitions, and its divergence from its language.

Only DataFrame functions: all counts of a document are array expressions inside its row, so nothing is
exploded and the only shuffle is the sum of a few numbers per language.

Base rules: fewer than `least_words` words, or more than half of the words in three-word windows that
occur twice, fail. Then the Jensen-Shannon distance (base 2, 0 to 1) of two histograms to the reference
of the document's language is taken: character classes, and the language's common words (with one bin
for all other words). Common words are counted: the `common_words` words that most of a language's documents
hold (ties: smaller ones first, by bytes), of at most `longest_word` characters. References are the sums over all documents of
that language that pass the base rules. The `languages` languages with most documents have references of their own; rarer
ones, empty and null ones share one group, for which only character classes count. A document is rejected when a distance exceeds its limit; each limit is wider for short texts by slack / sqrt(n),
and below `guard_words` words (or `guard_chars` characters) the distance doesn't count at all.

Defined results: a null text has no words and fails; a null language belongs to the shared group.
Repeated rows stay repeated. Input columns keep their names; own columns are made under names that start
with `_q_` and only those asked for leave the operator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, words

OTHER = ""
FEW = 48
SHARES = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    least_words: int = 50
    repeat_percent: int = 50
    guard_words: int = 50
    guard_chars: int = 200
    class_distance: float = 0.20
    class_slack: float = 2.0
    word_distance: float = 0.12
    word_slack: float = 2.2
    common_words: int = 12
    languages: int = 200
    longest_word: int = 40


def language_words(df: DataFrame, text_col: str, lang_col: str, limits: Limits) -> dict[str, list[str]]:
    """Each of the largest languages with its common words: `languages` times `common_words` words at most.

    Words are counted once a document and summed before they are shuffled; a language's words are ranked in
    shares by hash first, so that no task holds a whole vocabulary.
    """
    named = df.select(F.col(lang_col).alias("_q_group"), F.col(text_col).alias("_q_in")).filter(F.col("_q_group") != OTHER)
    largest = [r["_q_group"] for r in named.groupBy("_q_group").count().orderBy(F.desc("count"), "_q_group").limit(limits.languages).collect()]
    if not largest:
        return {}
    each = named.filter(F.col("_q_group").isin(largest)).select("_q_group", F.explode(F.array_distinct(words(F.col("_q_in")))).alias("_q_word"))
    held = each.filter(F.length("_q_word") <= limits.longest_word).groupBy("_q_group", "_q_word").agg(F.count(F.lit(1)).alias("_q_held"))
    order = (F.desc("_q_held"), F.col("_q_word"))
    share = W.partitionBy("_q_group", F.pmod(F.xxhash64("_q_word"), F.lit(SHARES))).orderBy(*order)
    some = held.withColumn("_q_k", F.row_number().over(share)).filter(F.col("_q_k") <= limits.common_words)
    best = some.withColumn("_q_k", F.row_number().over(W.partitionBy("_q_group").orderBy(*order))).filter(F.col("_q_k") <= limits.common_words)
    found = {k: [] for k in sorted(largest)}
    for r in sorted(best.collect(), key=lambda r: r["_q_k"]):
        found[r["_q_group"]].append(r["_q_word"])
    return found


def covered_words(starts: Column) -> Column:
    """Words inside three-word windows with these starts (ascending)."""
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])


def with_counts(df: DataFrame, text_col: str, lang_col: str, common: dict[str, list[str]]) -> DataFrame:
    """Adds `_q_` columns: the counts, the two histograms and the language's group. `common`: words by language."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    group = F.when(F.col(lang_col).isin(list(common)), F.col(lang_col)).otherwise(OTHER)
    none, whole = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    lists = F.create_map(*[x for k, v in common.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    own = F.coalesce(F.try_element_at(lists, group), whole) if common else whole
    # Each step's arrays are columns of their own, used twice or more in the next, so that none of them
    # is moved into a lambda and made again for each element.
    df = df.withColumns({"_q_text": t, "_q_w": words(F.col(text_col)), "_q_group": group, "_q_list": own})
    w = F.col("_q_w")
    df = df.withColumns({
        "_q_n_words": F.size(w).cast("bigint"),
        "_q_word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "_q_lines": F.filter(F.split("_q_text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")),
        "_q_h": F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(none),
        "_q_common": F.filter(w, lambda x: x.isin(sorted(set().union(*common.values())))),
        "_q_chars": F.length("_q_text").cast("bigint"),
        "_q_n_symbols": F.regexp_count("_q_text", F.lit("[#*$%&|<>]")).cast("bigint"),
        "_q_upper": F.regexp_count("_q_text", F.lit("[A-Z]")).cast("bigint"),
        "_q_digit": F.regexp_count("_q_text", F.lit("[0-9]")).cast("bigint"),
        "_q_mark": F.regexp_count("_q_text", F.lit("[.,;:!?]")).cast("bigint"),
        "_q_wide": (F.octet_length("_q_text") - F.length("_q_text")).cast("bigint"),
    }).drop("_q_text", "_q_w")
    h = F.col("_q_h")
    df = df.withColumn("_q_sorted", F.sort_array(h))
    ordered = F.col("_q_sorted")
    df = df.withColumns({
        "_q_again": F.array_distinct(F.filter(ordered, lambda x, j: x == F.get(ordered, j - 1))),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"),
        "_q_words": F.transform("_q_list", lambda c: (F.size("_q_common") - F.size(F.array_remove("_q_common", c))).cast("bigint")),
    }).drop("_q_lines", "_q_sorted")
    again = F.col("_q_again")
    # A few repeated windows are looked up one by one; many are found by sorting windows with their starts.
    df = df.withColumn("_q_pairs", F.when(F.size(again) > FEW, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    pairs = F.col("_q_pairs")
    twice = F.filter(pairs, lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"]))
    single = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda x: x.isNotNull())
    df = df.withColumn("_q_starts", F.when(F.size(again) == 0, F.array().cast("array<int>")).when(F.size(again) <= FEW, single).otherwise(F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("_q_pairs", "_q_h", "_q_again")
    total = F.aggregate("_q_words", F.lit(0).cast("bigint"), lambda a, x: a + x)
    df = df.withColumn("_q_other", F.col("_q_n_words") - total)
    df = df.withColumn("_q_n_repeat_words", F.coalesce(covered_words(F.col("_q_starts")), F.lit(0)).cast("bigint")).drop("_q_starts")
    rest = F.greatest(F.lit(0), F.col("_q_word_chars") - F.col("_q_upper") - F.col("_q_digit") - F.col("_q_mark") - F.col("_q_n_symbols"))
    return df.withColumns({
        "_q_classes": F.array("_q_upper", "_q_digit", "_q_mark", "_q_n_symbols", "_q_wide", F.col("_q_chars") - F.col("_q_word_chars"), rest.cast("bigint")),
        "_q_bins": F.concat("_q_words", F.array("_q_other")),
    })


def base_failed(limits: Limits) -> Column:
    return (F.col("_q_n_words") < limits.least_words) | (100 * F.col("_q_n_repeat_words") > limits.repeat_percent * F.col("_q_n_words"))


def references(counted: DataFrame, limits: Limits) -> DataFrame:
    """One row per language group (`languages` and one more at most): summed histograms."""
    # Failed rows are left out inside the sums: a filter would move below the counts and repeat their expressions.
    ok = ~base_failed(limits)
    n_classes, n_words = 7, 1 + limits.common_words
    sums = [F.sum(F.when(ok, F.get("_q_classes", F.lit(i)))).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.when(ok, F.get("_q_bins", F.lit(i)))).alias(f"w{i}") for i in range(n_words)]
    return counted.groupBy("_q_group").agg(*sums).filter("c0 is not null").select(
        F.col("_q_group").alias("_q_ref"),
        F.array(*(f"c{i}" for i in range(n_classes))).alias("_q_ref_classes"),
        F.filter(F.array(*(f"w{i}" for i in range(n_words))), lambda x: x.isNotNull()).alias("_q_ref_bins"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count histograms of equal length; 0 when one of them is empty."""
    zero = F.lit(0.0)

    def total(x: Column) -> Column:
        return F.aggregate(x, zero, lambda a, v: a + v.cast("double"))

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(zero)

    tp, tq = total(p), total(q)
    terms = F.zip_with(p, q, lambda x, y: part(x / tp, (x / tp + y / tq) / 2) + part(y / tq, (x / tp + y / tq) / 2))
    found = F.sqrt(F.greatest(zero, F.aggregate(terms, zero, lambda a, v: a + v) / 2))
    return F.when((tp > 0) & (tq > 0), found).otherwise(zero)


def judged(counted: DataFrame, refs: DataFrame, limits: Limits) -> DataFrame:
    """Adds `_q_base_failed`, `_q_class_js`, `_q_word_js` and `_q_kept`. `refs` has a row per language group."""
    df = counted.join(F.broadcast(refs), F.col("_q_group") == F.col("_q_ref"), "left")
    df = df.withColumns({
        "_q_base_failed": base_failed(limits),
        "_q_class_js": F.coalesce(js_distance(F.col("_q_classes"), F.col("_q_ref_classes")), F.lit(0.0)),
        "_q_word_js": F.when(F.col("_q_group") != OTHER, F.coalesce(js_distance(F.col("_q_bins"), F.col("_q_ref_bins")), F.lit(0.0))).otherwise(0.0),
    })
    far = (F.col("_q_chars") >= limits.guard_chars) & (F.col("_q_class_js") > limits.class_distance + limits.class_slack / F.sqrt(F.greatest(F.lit(1), F.col("_q_chars"))))
    odd = (F.col("_q_n_words") >= limits.guard_words) & (F.col("_q_word_js") > limits.word_distance + limits.word_slack / F.sqrt(F.greatest(F.lit(1), F.col("_q_n_words"))))
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & ~far & ~odd)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row per document: id, the counts, base_failed, kept and both distances.

    The counts are stored once in the shared folder; references and verdicts read only those.
    """
    needed = ["_q_group", "_q_chars", "_q_classes", "_q_bins", *(f"_q_{c}" for c in COUNTS)]
    only = df.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_in"), F.col(lang_col).alias("_q_lang"))
    counted = materialise(with_counts(only, "_q_in", "_q_lang", language_words(df, text_col, lang_col, limits)).select("_q_id", *needed), "quality")
    done = judged(counted, references(counted, limits), limits)
    return done.select(F.col("_q_id").alias(id_col), *(F.col(f"_q_{c}").alias(c) for c in COUNTS), F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_class_js").alias("class_js"), F.col("_q_word_js").alias("word_js"))


def kept_rows(df: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with the columns of the input. Counts twice instead of shuffling texts."""
    counted = with_counts(df, text_col, lang_col, language_words(df, text_col, lang_col, limits))
    refs = materialise(references(counted, limits), "references")
    # Always true, but not known before the row is made: else the filter would move below the counts,
    # where their expressions would be repeated inside one another.
    made = F.monotonically_increasing_id() >= 0
    return judged(counted, refs, limits).withColumn("_q_kept", F.col("_q_kept") & made).filter("_q_kept").select(*df.columns)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; distances to 9 digits."""
    found = quality_rules(documents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("class_js", "word_js")})


def _sql(limits: Limits = Limits()) -> str:
    js = "round({0}, 9) + cast(0 as double)"
    distance = """sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: (case when {p}[i] > 0 then {p}[i] / {tp} * log2(2 * {p}[i] / {tp} / ({p}[i] / {tp} + {q}[i] / {tq})) else 0 end) + (case when {q}[i] > 0 then {q}[i] / {tq} * log2(2 * {q}[i] / {tq} / ({p}[i] / {tp} + {q}[i] / {tq})) else 0 end))) / 2))"""
    by_class, by_word = (f"case when {tp} > 0 and {tq} > 0 then {distance.format(p=p, q=q, tp=tp, tq=tq)} else 0 end" for p, q, tp, tq in (("classes", "ref_classes", "tc", "trc"), ("bins", "ref_bins", "tb", "trb")))
    return f"""
with largest as (
  select lang from documents where lang != '' group by lang order by count(*) desc, lang limit {limits.languages}
), t as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, case when lang in (from largest) then lang else '' end as lg from documents
), held as (
  select lg, x, count(*) as n from (select lg, unnest(list_distinct(w)) as x from t where lg != '') where len(x) <= {limits.longest_word} group by lg, x
), common as (
  select lg, list(x order by k) as l from (select *, row_number() over (partition by lg order by n desc, x) as k from held) where k <= {limits.common_words} group by lg
), g as (
  select t.*, coalesce(l, []) as l, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t left join common on common.lg = t.lg
), win as (
  select doc_id, i, array_to_string(w[i:i + 2], ' ') as s from t, unnest(range(1, len(w) - 1)) u(i)
), rep as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from win) where c > 1
), cov as (
  select doc_id, count(distinct i + d) as n from rep, (select unnest(range(3)) as d) group by doc_id
), c as (
  select g.doc_id, lg, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(t) as chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]')) as up, len(regexp_extract_all(t, '[0-9]')) as dg, len(regexp_extract_all(t, '[.,;:!?]')) as mk, strlen(t) - len(t) as wide, list_transform(l, lambda x: len(list_filter(w, lambda y: y = x))) as cw
  from g left join cov on cov.doc_id = g.doc_id
), f as (
  select *, [up, dg, mk, n_symbols, wide, chars - word_chars, greatest(0, word_chars - up - dg - mk - n_symbols)] as classes, list_append(cw, n_words - coalesce(list_sum(cw), 0)) as bins,
    n_words < {limits.least_words} or 100 * n_repeat_words > {limits.repeat_percent} * n_words as base_failed from c
), rc as (
  select lg, list(s order by i) as ref_classes from (select lg, i, sum(classes[i]) as s from f, unnest(range(1, 8)) u(i) where not base_failed group by lg, i) group by lg
), rb as (
  select lg, list(s order by i) as ref_bins from (select lg, i, sum(bins[i]) as s from f, unnest(range(1, len(bins) + 1)) u(i) where not base_failed group by lg, i) group by lg
), s as (
  select f.*, ref_classes, ref_bins, cast(list_sum(classes) as double) as tc, cast(list_sum(bins) as double) as tb, cast(list_sum(ref_classes) as double) as trc, cast(list_sum(ref_bins) as double) as trb from f left join rc using (lg) left join rb using (lg)
), d as (
  select *, {by_class} as cj, case when lg = '' then 0 else {by_word} end as wj from s
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not (chars >= {limits.guard_chars} and cj > {limits.class_distance}::double + {limits.class_slack}::double / sqrt(greatest(1, chars))) and not (n_words >= {limits.guard_words} and wj > {limits.word_distance}::double + {limits.word_slack}::double / sqrt(greatest(1, n_words))) as kept,
  {js.format('cj')} as class_js, {js.format('wj')} as word_js
from d
"""


OP6_SQL = _sql()
