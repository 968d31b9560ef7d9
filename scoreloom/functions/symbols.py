"""Gene symbol cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tokens that mean "no symbol".
NULL_TOKENS = ("", "NAN", "NONE", "NA")
UNMAPPED = "ENSCAFG"


def plain(symbol: Column) -> Column:
    """Upper case without surrounding white space."""
    return F.upper(F.trim(symbol))


def cleaned(symbol: Column) -> Column:
    """Null tokens to ''; of parts joined by | the last that is mapped, else the last; without a version."""
    s = plain(symbol)
    parts = F.filter(F.transform(F.split(s, r"\|"), F.trim), lambda x: x != "")
    mapped = F.filter(parts, lambda x: ~x.startswith(UNMAPPED))
    last = F.when(F.size(mapped) > 0, F.element_at(mapped, -1)).otherwise(F.element_at(parts, -1))
    chosen = F.when(s.contains("|") & (F.size(parts) > 0), last).otherwise(s)
    return F.when(F.coalesce(s, F.lit("")).isin(*NULL_TOKENS), "").otherwise(F.regexp_replace(chosen, r"\.[0-9]+$", ""))


def identifier(symbol: Column) -> Column:
    """A usable symbol or '': takes labelled values, the last mapped part, drops versions and copies."""
    s = plain(symbol)
    labelled = F.regexp_extract(s, r"(?:GENE_NAME=|SYMBOL:)\s*([^;|,\s]+)", 1)
    s = F.when(labelled != "", labelled).otherwise(s)
    bar = F.filter(F.transform(F.split(s, r"\|"), F.trim), lambda x: (x != "") & ~x.startswith(UNMAPPED))
    s = F.when(s.contains("|"), F.coalesce(F.try_element_at(bar, F.lit(-1)), F.lit(""))).otherwise(s)
    semi = F.filter(F.transform(F.split(s, ";"), F.trim), lambda x: x.rlike(r"^[A-Z][A-Z0-9_.-]*$"))
    s = F.when(s.contains(";"), F.coalesce(F.try_element_at(semi, F.lit(-1)), F.lit(""))).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, r"\.[0-9]+$", ""), r"_[0-9]+$", "")
    good = ~s.isin(*NULL_TOKENS, "---") & ~s.startswith(UNMAPPED) & s.rlike(r"^[A-Z][A-Z0-9_.-]*$")
    return F.when(good, s).otherwise("")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_nth = 1").drop("_nth")


def parsed_boolean(text: Column) -> Column:
    """true/false/1/0/yes/no in any case; NULL stays; anything else raises."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False).when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean"))


def symbol_list(text: Column) -> Column:
    """Distinct upper-case symbols of a ;-joined list in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), plain), lambda x: x != ""))


def mapped(x: Column, values: dict, default=None) -> Column:
    """The value a fixed table gives to x; others the default."""
    table = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    return F.coalesce(F.try_element_at(table, x), F.lit(default)) if values else F.lit(default)


def first_rule(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that the text matches; the order of the rules decides."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.coalesce(x, F.lit("")).rlike(pattern), label).otherwise(out)
    return out
