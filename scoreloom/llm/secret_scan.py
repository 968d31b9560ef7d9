"""Secret scan: strong patterns, and weak parts of a credential that count only next to each other.

Only DataFrame functions. A text's matches of a pattern are `regexp_extract_all`; the stretches between
them are `split` by the same pattern; running lengths of both give each match's place in code points.
Patterns run only on texts that hold a literal which every match needs.

Strong spans (`assign`, `access`, `hex`) are always reported. Weak parts are identifiers (user, login,
client id), secrets (mixed strings of 20 or more characters) and endpoints (addresses with a scheme, or
host settings). Two parts are linked when one lies in the innermost {...} around the other (at any depth), when
both are in one paragraph (blank lines end it) and on different lines, when both are on one line and at least one of
them outside all {...}, or when the gap between their intervals is at most `reach` code points;
weak parts that overlap a strong span are left out, as they are reported already.
An identifier is reported if a secret (weak, `assign` or `hex`) is linked to it, a secret if an identifier
(weak or `access`) is, an endpoint if an identifier and a secret are. The interval join happens inside the
document's row: parts of a document never leave it, so there is no shuffle. It is a sweep: parts, braces and
line ends are sorted by place, and folds with a state of fixed size carry what was met on the left, then on the
right. Its time grows as n log n with the matches of a text; no two parts are ever compared as a pair.

Defined results: null text counts as empty and has no spans; the digest is then that of ''. Repeated rows
stay repeated. Other columns pass only in `redact`, where clashing names cannot arise: helper columns
start with `_s_` and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

# The strong patterns (Java syntax; (?i) folds ASCII letters only).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# The weak parts.
WEAK_ID = r"""(?i)(?<![a-z])(?:user|username|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i)(?:https?|ftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|(?<![a-z])(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?"""
BLANK = r"\n[\x20\t\r]*\n"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Items of a block of a fold.
CHUNK = 128
#: Code points of the blocks from which masked texts are put together.
BLOCK = 4096
SPAN = "array<struct<s:int,k:int,e:int>>"
PLACED = "struct<s:int,k:int,e:int,a:int,b:int,p:int,l:int>"
#: Further than any place in a text, and far from the largest integer.
FAR = 1_500_000_000
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ID_WORDS = ("user", "login", "account", "client_id", "clientid", "access_key", "accesskey")
ENDPOINT_WORDS = ("://", "host", "endpoint", "server")


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, f) -> Column:
    """f(value), with the value made once however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def folded(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """Elements of `kind` that a fold over `items` emits; time is about in proportion to their number.

    `step(state, item)` gives the integer fields that change, the element, and whether it is emitted. A fold copies its
    whole state at each item, so no array may grow along all items: the items are cut into blocks; one fold
    notes the state before each block, then each block is folded by itself and gathers its own elements.
    """
    def after(a: Column, fields: dict[str, Column]) -> Column:
        return F.struct(*[fields.get(k, a[k]).alias(k) for k in state])

    def blocks_of(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, CHUNK))

    def noted(c: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, c["now"], lambda a, x: after(a, step(a, x)[0])).alias("now"), F.concat(c["before"], F.array(c["now"])).alias("before"))

    def emitted(block: Column, before: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            fields, element, wanted = step(a["now"], x)
            return F.struct(after(a["now"], fields).alias("now"), F.when(wanted, F.concat(a["out"], F.array(element))).otherwise(a["out"]).alias("out"))

        return F.aggregate(block, F.struct(before.alias("now"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda a: a["out"])

    def whole(blocks: Column) -> Column:
        none_yet = F.array().cast("array<struct<" + ",".join(f"{k}:int" for k in state) + ">>")
        start = F.struct(F.struct(*[v.alias(k) for k, v in state.items()]).alias("now"), none_yet.alias("before"))
        return F.flatten(F.zip_with(blocks, F.aggregate(blocks, start, noted, lambda c: c["before"]), emitted))

    return let(items, lambda x: let(blocks_of(x), whole))


def spans_of(gaps: Column, found: Column, kind: int) -> Column:
    """Spans (start, kind, end) of matches, from the stretches before them and the matches themselves."""
    def step(a: Column, x: Column):
        s = a["at"] + x["g"]
        return {"at": s + x["m"]}, F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["m"]).alias("e")), F.lit(True)

    both = F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return folded(F.filter(both, lambda x: x["m"].isNotNull()), {"at": F.lit(0)}, step, "struct<s:int,k:int,e:int>")


def spans(text: Column, pattern: str, kind: int, may: Column) -> Column:
    """Spans of a pattern's matches in texts for which `may` holds."""
    return F.when(may, spans_of(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), kind)).otherwise(none())


def any_of(text: Column, literals: tuple[str, ...]) -> Column:
    out = text.contains(literals[0])
    for x in literals[1:]:
        out = out | text.contains(x)
    return out


def objects(text: Column) -> Column:
    """Spans of all {...} of a text, whatever their depth; braces without a partner are none.

    A brace's level is the number of objects open there. Sorted by level and place, an opening brace stands
    right before the brace that closes it, so that no stack is needed.
    """
    both = F.zip_with(F.transform(F.split(text, "[{}]", -1), F.length), F.regexp_extract_all(text, F.lit("[{}]"), F.lit(0)), lambda g, b: F.struct(g.alias("g"), b.alias("b")))

    def step(a: Column, x: Column):
        s, opens = a["at"] + x["g"], x["b"] == "{"
        level = a["d"] + F.when(opens, 1).otherwise(0)
        after = F.when(opens, a["d"] + 1).otherwise(F.greatest(a["d"] - 1, F.lit(0)))
        return {"at": s + 1, "d": after}, F.struct(level.alias("d"), s.alias("s"), opens.cast("int").alias("o")), level > 0

    levels = F.sort_array(folded(F.filter(both, lambda x: x["b"].isNotNull()), {"at": F.lit(0), "d": F.lit(0)}, step, "struct<d:int,s:int,o:int>"))

    # A fold hands each brace on to the next one.
    def pair(a: Column, y: Column):
        closes = (a["d"] == y["d"]) & (a["o"] == 1) & (y["o"] == 0)
        return {"d": y["d"], "s": y["s"], "o": y["o"]}, F.struct(a["s"].alias("s"), F.lit(0).alias("k"), (y["s"] + 1).alias("e")), closes

    return folded(levels, {"d": F.lit(0), "s": F.lit(0), "o": F.lit(0)}, pair, "struct<s:int,k:int,e:int>")


def apart(parts: Column) -> Column:
    """Parts sorted by start, without the weak ones that overlap a strong span."""
    kind = "struct<s:int,k:int,e:int>"

    def left(a: Column, x: Column):
        strong = x["k"] <= 2
        return {"m": F.when(strong, F.greatest(a["m"], x["e"])).otherwise(a["m"])}, x, strong | (a["m"] <= x["s"])

    def right(a: Column, x: Column):
        strong = x["k"] <= 2
        return {"m": F.when(strong, x["s"]).otherwise(a["m"])}, x, strong | (a["m"] >= x["e"])

    return F.reverse(folded(F.reverse(folded(parts, {"m": F.lit(-1)}, left, kind)), {"m": F.lit(FAR)}, right, kind))


def placed(parts: Column, braces: Column, breaks: Column, lines: Column) -> Column:
    """Parts by start, with the bounds of their innermost object `a`, `b` (-1: none), paragraph `p` and line `l`."""
    def events(spans: Column, t: int, at: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x[at].alias("s"), F.lit(t).alias("t"), x["k"].alias("k"), x["e"].alias("e")))

    def step(a: Column, x: Column):
        opens, part = x["t"] == 1, x["t"] == 4
        depth = a["d"] + F.when(opens, 1).when(x["t"] == 0, -1).otherwise(0)
        element = F.struct(depth.alias("d"), x["s"].alias("s"), part.alias("t"), x["k"].alias("k"), x["e"].alias("e"), a["p"].alias("p"), a["l"].alias("l"))
        return {"d": depth, "p": a["p"] + F.when(x["t"] == 3, 1).otherwise(0), "l": a["l"] + F.when(x["t"] == 2, 1).otherwise(0)}, element, opens | part

    by_place = F.sort_array(F.concat(events(braces, 0, "e"), events(braces, 1, "s"), events(lines, 2, "s"), events(breaks, 3, "s"), events(parts, 4, "s")))
    by_depth = F.sort_array(folded(by_place, {"d": F.lit(0), "p": F.lit(0), "l": F.lit(0)}, step, "struct<d:int,s:int,t:boolean,k:int,e:int,p:int,l:int>"))

    # By depth and place, a part follows the brace that opens its object.
    def held(a: Column, x: Column):
        inside = x["d"] > 0
        element = F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.when(inside, a["a"]).otherwise(-1).alias("a"), F.when(inside, a["b"]).otherwise(-1).alias("b"), x["p"].alias("p"), x["l"].alias("l"))
        return {"a": F.when(x["t"], a["a"]).otherwise(x["s"]), "b": F.when(x["t"], a["b"]).otherwise(x["e"])}, element, x["t"]

    return F.sort_array(folded(by_depth, {"a": F.lit(-1), "b": F.lit(-1)}, held, PLACED))


def role(x: Column) -> dict[str, Column]:
    """Whether a part is an identifier `i`, and whether it is a secret `c`."""
    return {"i": x["k"].isin(1, 3), "c": x["k"].isin(0, 2, 4)}


def linked(parts: Column, reach: int) -> Column:
    """Spans of the weak ones of placed parts that are linked with what they need.

    Per role the state holds, of the parts met so far: s the last start, e the furthest end (on the way back
    the first start of an object), b the furthest end of an object, p the last paragraph, l its first line met,
    q the last paragraph with a part outside all objects.
    """
    def wanted(x: Column, hit: dict[str, Column]) -> Column:
        return ((x["k"] == 3) & hit["c"]) | ((x["k"] == 4) & hit["i"]) | ((x["k"] == 5) & hit["i"] & hit["c"])

    def moved(a: Column, x: Column, more: dict) -> dict[str, Column]:
        out = {}
        for r, mine in role(x).items():
            new = {"s": x["s"], "p": x["p"], "l": F.when(a["p" + r] == x["p"], a["l" + r]).otherwise(x["l"]), "q": F.when(x["a"] < 0, x["p"]).otherwise(a["q" + r])}
            new |= {k: f(a[k + r]) for k, f in more.items()}
            out |= {k + r: F.when(mine, v).otherwise(a[k + r]) for k, v in new.items()}
        return out

    def scoped(a: Column, x: Column, r: str, other_line: Column) -> Column:
        same = a["p" + r] == x["p"]
        return (same & ((x["a"] < 0) | other_line)) | (a["q" + r] == x["p"])

    def left(a: Column, x: Column):
        hit = {r: (a["e" + r] + reach >= x["s"]) | ((x["a"] >= 0) & (a["s" + r] >= x["a"])) | (a["b" + r] > x["s"]) | scoped(a, x, r, a["l" + r] < x["l"]) for r in "ic"}
        element = F.struct(*[x[k].alias(k) for k in "skeabpl"], hit["i"].alias("hi"), hit["c"].alias("hc"))
        return moved(a, x, {"e": lambda e: F.greatest(e, x["e"]), "b": lambda b: F.greatest(b, x["b"])}), element, F.lit(True)

    def right(a: Column, x: Column):
        hit = {r: x["h" + r] | (a["s" + r] <= x["e"] + reach) | ((x["a"] >= 0) & (a["s" + r] < x["b"])) | (a["e" + r] <= x["s"]) | scoped(a, x, r, a["l" + r] > x["l"]) for r in "ic"}
        element = F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
        return moved(a, x, {"e": lambda e: F.when(x["a"] >= 0, F.least(e, x["a"])).otherwise(e)}), element, wanted(x, hit)

    first = {k + r: F.lit(v) for r in "ic" for k, v in {"s": -FAR, "e": -FAR, "b": -FAR, "p": -1, "l": -1, "q": -1}.items()}
    last = {k + r: F.lit(v) for r in "ic" for k, v in {"s": FAR, "e": FAR, "p": -1, "l": -1, "q": -1}.items()}
    forward = folded(parts, first, left, PLACED[:-1] + ",hi:boolean,hc:boolean>")
    return folded(F.reverse(forward), last, right, "struct<s:int,k:int,e:int>")


def with_spans(df: DataFrame, text_col: str, reach: int) -> DataFrame:
    """Adds `_s_base` and `_s_all`: sorted spans of strong kinds, and with the linked weak parts."""
    df = df.withColumn("_s_text", F.coalesce(F.col(text_col), F.lit("")))
    t = F.col("_s_text")
    df = df.withColumn("_s_low", F.lower(t))
    low = F.col("_s_low")
    df = df.withColumns({"_s_m1": any_of(low, ASSIGN_WORDS), "_s_m2": t.contains("AKIA"), "_s_m3": t.rlike("[0-9a-f]{32}"), "_s_m4": any_of(low, ID_WORDS), "_s_m6": any_of(low, ENDPOINT_WORDS)}).drop("_s_low")
    long_enough = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 8)
    df = df.withColumns({
        "_s_assign": F.when(F.col("_s_m1"), F.transform(F.filter(F.arrays_zip(spans(t, ASSIGN, 0, F.lit(True)).alias("x"), long_enough.alias("y")), lambda z: z["y"]), lambda z: z["x"])).otherwise(none()),
        "_s_access": spans(t, ACCESS, 1, F.col("_s_m2")),
        "_s_hex": spans(t, HEX, 2, F.col("_s_m3")),
        "_s_id": spans(t, WEAK_ID, 3, F.col("_s_m4")),
    })
    df = df.withColumns({
        "_s_base": F.sort_array(F.concat("_s_assign", "_s_access", "_s_hex")),
        "_s_secret": spans(t, WEAK_SECRET, 4, (F.size("_s_id") > 0) | (F.size("_s_access") > 0)),
        "_s_end": spans(t, ENDPOINT, 5, F.col("_s_m6") & ((F.size("_s_id") > 0) | (F.size("_s_access") > 0))),
    })
    need, t = ((F.size("_s_id") > 0) | (F.size("_s_access") > 0)) & ((F.size("_s_secret") > 0) | (F.size("_s_assign") > 0) | (F.size("_s_hex") > 0)), F.col("_s_text")
    df = df.withColumn("_s_parts", F.when(need, apart(F.sort_array(F.concat("_s_base", "_s_id", "_s_secret", "_s_end")))).otherwise(none()))
    weak = (F.size("_s_parts") > F.size("_s_base"))
    df = df.withColumns({"_s_objects": F.when(weak, objects(t)).otherwise(none()), "_s_breaks": spans(t, BLANK, 0, weak), "_s_lines": spans(t, "\n", 0, weak)})
    df = df.withColumn("_s_weak", F.when(weak, linked(placed(F.col("_s_parts"), F.col("_s_objects"), F.col("_s_breaks"), F.col("_s_lines")), reach)).otherwise(none()))
    return df.withColumn("_s_all", F.sort_array(F.concat("_s_base", "_s_weak")))


def written(spans_col: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 160) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_linked, base_sha256, spans."""
    only = df.select(F.col(id_col).alias("_s_key"), F.col(text_col).alias("_s_in"))
    done = with_spans(only, "_s_in", reach)
    return done.select(
        F.col("_s_key").alias(id_col),
        F.size("_s_assign").cast("bigint").alias("n_assign"), F.size("_s_access").cast("bigint").alias("n_access"), F.size("_s_hex").cast("bigint").alias("n_hex"),
        (F.size("_s_all") - F.size("_s_base")).cast("bigint").alias("n_linked"),
        F.sha2(written("_s_base"), 256).alias("base_sha256"), written("_s_all").alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", reach: int = 160, mask: str = "[SECRET]") -> DataFrame:
    """The input's rows and columns; every reported span of the text is replaced by `mask`.

    Overlapping spans are replaced together, touching ones one by one. Rows without spans, null texts included, stay as they are.
    """
    done = with_spans(df, text_col, reach)
    t = F.col("_s_text")

    def step(a: Column, x: Column):
        # the stretch before a span that starts behind all earlier ones
        return {"at": F.greatest(a["at"], x["e"])}, F.struct(a["at"].alias("s"), x["s"].alias("e")), x["s"] >= a["at"]

    last = F.struct(F.array_max(F.transform("_s_all", lambda x: x["e"])).alias("s"), F.length(t).alias("e"))
    kept = F.concat(folded(F.col("_s_all"), {"at": F.lit(0)}, step, "struct<s:int,e:int>"), F.array(last))
    done = done.withColumn("_s_kept", F.when(F.size("_s_all") > 0, kept))
    # A substring is counted out from the start of its text: stretches are cut from short blocks.
    done = done.withColumn("_s_blocks", F.when(F.col("_s_kept").isNotNull(), F.transform(F.sequence(F.lit(0), (F.length(t) / BLOCK).cast("int")), lambda i: t.substr(i * BLOCK + 1, F.lit(BLOCK)))))

    def stretch(x: Column) -> Column:
        def of_block(i: Column) -> Column:
            a, b = F.greatest(x["s"] - i * BLOCK, F.lit(0)), F.least(x["e"] - i * BLOCK, F.lit(BLOCK))
            return F.get("_s_blocks", i).substr(a + 1, b - a)

        whole = F.sequence((x["s"] / BLOCK).cast("int"), ((x["e"] - 1) / BLOCK).cast("int"))
        return F.when(x["e"] > x["s"], F.array_join(F.transform(whole, of_block), "")).otherwise("")

    # Two uses of the blocks keep them a column of their own, which isn't moved into the lambda and made for each element.
    masked = F.when(F.size("_s_blocks") > 0, F.array_join(F.transform("_s_kept", stretch), mask))
    done = done.withColumn("_s_masked", F.when(F.size("_s_all") > 0, masked).otherwise(F.col(text_col)))
    return done.select(*[F.col("_s_masked").alias(c) if c == text_col else F.col(c) for c in df.columns])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan(documents(spark, sf_dir))
