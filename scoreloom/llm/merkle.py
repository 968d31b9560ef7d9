"""Merkle dataset manifest: a digest for every document, subtree, group and the whole table, with proofs.

Leaves of a group (a language) in order make a tree of pairs; the groups' roots in order make another one.

1. Leaf digests are made by SQL functions; only they and the sort key move on, never the texts.
2. A range partitioning puts leaves in order; places within a group are counted per partition and carried
   on (two-level scan), so that no group is sorted or counted in one task.
3. `traverse`: groups of BLOCK consecutive leaves, aligned, are walked by recursion in postorder; a call returns its
   subtree's digest, and on the way back each half's digest is appended to the proofs of the other half's leaves.
   The block roots are the leaves of the next distributed traversal, until a group has one root.
4. The groups' roots are traversed alike, as one sequence.
5. Proofs of the levels are joined (a key is a block, 1024 leaves at most) and folded.

A proof is an array of steps, from the leaf up: one byte (0: no sibling, the node is hashed alone; 1: the
sibling is to the left; 2: to the right) and the sibling's 32 bytes.

Defined results: null groups and null keys come first; rows with equal keys are ordered by their leaf digests;
repeated rows are leaves of their own, next to each other. An empty table gives no rows. Other columns are
not read unless named. A null identifier has no crc32 and is never changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialise

HEIGHT = 10
BLOCK = 1 << HEIGHT

NODE = "grp string, pos bigint, digest binary, proof array<binary>, block_root binary"


def node(*digests: bytes) -> bytes:
    """Digest of the children's digests as hex text, joined."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of fields in order, each its byte count, ':' and value; '-' where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def climb(leaves: list[bytes], height: int) -> tuple[bytes, list[list[bytes]]]:
    """Root and proofs of an aligned block, walked in postorder to this height."""
    proofs: list[list[bytes]] = [[] for _ in leaves]

    def walk(at: int, level: int) -> bytes:
        if level == 0:
            return leaves[at]
        half = 1 << (level - 1)
        left = walk(at, level - 1)
        end = min(at + half, len(leaves))
        if at + half >= len(leaves):
            for k in range(at, end):
                proofs[k].append(b"\0")
            return node(left)
        right = walk(at + half, level - 1)
        for k in range(at, end):
            proofs[k].append(b"\2" + right)
        for k in range(at + half, min(at + 2 * half, len(leaves))):
            proofs[k].append(b"\1" + left)
        return node(left, right)

    return walk(0, height), proofs


def fold(leaf: bytes, proof: list[bytes]) -> bytes:
    """The root that a leaf and its proof give."""
    return reduce(lambda d, s: node(d) if s[0] == 0 else node(s[1:], d) if s[0] == 1 else node(d, s[1:]), proof, leaf)


def placed(df: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """The rows with their place `pos` among those of their group and the group's size `n`.

    Two-level scan over range partitions: places within a partition, then the partitions' counts summed up.
    """
    schema = T.StructType([*df.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, k = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for g in batch.column("grp").to_pylist():
                k = k + 1 if g == last else 0
                last = g
                places.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "place"])

    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = materialise(ordered.mapInArrow(work, schema), what)
    counts = rows.groupBy(group, "part").agg((F.max("place") + 1).alias("k"))
    by = W.partitionBy(group)
    starts = counts.select(group, "part", (F.sum("k").over(by.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(by).alias("n"))
    return rows.join(starts, [group, "part"]).withColumn("pos", F.col("before") + F.col("place")).drop("part", "place", "before")


def traverse(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (grp, pos, n, digest) walked: grp, pos, digest, proof within the block, block_root."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        n = group.column("n")[0].as_py()
        leaves = group.column("digest").to_pylist()
        height = HEIGHT if n > BLOCK else max(0, n - 1).bit_length()
        root, proofs = climb(leaves, height)
        return pa.table({"grp": group.column("grp"), "pos": group.column("pos"), "digest": group.column("digest"), "proof": pa.array(proofs, pa.list_(pa.binary())), "block_root": pa.array([root] * len(leaves), pa.binary())})

    block = F.shiftright("pos", HEIGHT).alias("block")
    return nodes.select("grp", block, "pos", "n", "digest").groupBy("grp", "block").applyInArrow(work, NODE)


def joined(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Proofs of nodes lengthened by those of their blocks."""
    up = upper.select("grp", F.col("pos").alias("block"), F.col("proof").alias("rest"), "root")
    low = lower.withColumn("block", F.shiftright("pos", HEIGHT))
    return low.join(up, ["grp", "block"]).select("grp", "pos", "digest", F.concat("proof", "rest").alias("proof"), "root")


def trees(nodes: DataFrame, what: str) -> DataFrame:
    """Whole trees of all groups: grp, pos, digest, proof up to the group's root, root.

    A traversal turns n nodes into n / 1024 block roots, so few are needed at any size.
    """
    levels = []
    while True:
        walked = materialise(traverse(nodes), what)
        levels.append(walked)
        # a group with one block has its root; the others go on
        above = walked.filter(F.col("pos") % BLOCK == 0).select("grp", F.shiftright("pos", HEIGHT).alias("pos"), F.col("block_root").alias("digest"))
        sizes = above.groupBy("grp").agg((F.max("pos") + 1).alias("n"))
        nodes = above.join(sizes, "grp")
        if sizes.filter("n > 1").limit(1).count() == 0:
            break
    found = levels[-1].select("grp", "pos", "digest", "proof", F.col("block_root").alias("root"))
    for lower in reversed(levels[:-1]):
        found = joined(lower, found)
    return found


def manifest(df: DataFrame, group_col: str, key_col: str, fields: list[Column], changed: list[Column] | None = None, change: Column | None = None) -> DataFrame:
    """One row per input row: its key, group and leaf, subroot, root, proof (binary), proof_sha256, folded_root, verified.

    `fields` make a leaf; where `change` holds, the check takes the leaf of `changed` instead, as if the row
    had been altered since. folded_root is what the checked leaf and the stored proof give; verified, whether it is the root.
    """
    leaf = leaf_digest(fields)
    other = F.when(change, leaf_digest(changed)) if change is not None else F.lit(None).cast("binary")
    # a value for null groups that sorts first
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = materialise(df.select(F.col(key_col).alias("key"), group.alias("grp"), leaf.alias("digest"), other.alias("now")), "leaves")
    rows = materialise(placed(leaves, "grp", ["key", "digest"], "ordered"), "placed")
    within = trees(rows.select("grp", "pos", "n", "digest"), "walked")
    roots = materialise(within.filter("pos = 0").select("grp", "root"), "subroots")
    # the groups' roots in order, as one group of their own
    top = placed(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), "grp", ["name"], "subroots-ordered")
    top = materialise(top, "subroots-placed")
    whole = trees(top.select("grp", "pos", "n", "digest"), "top").select("pos", F.col("proof").alias("rest"), F.col("root").alias("top"))
    above = top.select("pos", "name").join(whole, "pos").select(F.col("name").alias("grp"), "rest", "top")
    paths = within.select("grp", "pos", "digest", "proof", "root").join(rows.select("grp", "pos", "key", "now"), ["grp", "pos"])
    # every row needs its group's path: few groups are sent to the tasks, many are joined by group and block of places
    if roots.count() <= BLOCK:
        every = paths.join(F.broadcast(above), "grp")
    else:
        salted = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        every = paths.withColumn("salt", (F.shiftright("pos", HEIGHT) % 16).cast("int")).join(salted, ["grp", "salt"])
    every = every.select("key", "grp", "digest", "now", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("proof", "rest").alias("proof"))
    schema = f"key {dict(leaves.dtypes)['key']}, grp string, digest binary, subroot binary, root binary, proof array<binary>, proof_sha256 binary, folded binary"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs = batch.column("proof").to_pylist()
            digests = [node(*(s[1:] for s in p if s[0])) for p in proofs]
            folded = [fold(d if x is None else x, p) for d, x, p in zip(batch.column("digest").to_pylist(), batch.column("now").to_pylist(), proofs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "grp", "digest", "subroot", "root", "proof")] + [pa.array(digests, pa.binary()), pa.array(folded, pa.binary())], ["key", "grp", "digest", "subroot", "root", "proof", "proof_sha256", "folded"])

    done = every.mapInArrow(check, schema)
    text = lambda c: F.lower(F.hex(c))
    return done.select(
        F.col("key").alias(key_col), F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("tree"), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        "proof", text("proof_sha256").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, checked after a change to the stated ones."""
    docs = documents(spark, sf_dir)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = [more if c == 3 else x for c, x in enumerate(fields)]
    change = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, "lang", "doc_id", fields, changed, change)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: crc32 bit by bit, trees by repeated grouping, and folding by a second recursion.
OP13_SQL = """
with recursive f as (
  select doc_id, lang, doc_id::varchar as a, source as b, lang as c, n_chars::varchar as d, (n_chars::hugeint + 1)::varchar as d2, text as e,
    list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda r, x:
      list_reduce(list_concat([xor(r, x)], range(8)), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))) as r from documents
), l as (
  select doc_id, lang, xor(r, 4294967295) % 7 = 0 as hit, sha256(coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(b) || ':' || b, '-') || coalesce(strlen(c) || ':' || c, '-') || coalesce(strlen(d) || ':' || d, '-') || coalesce(strlen(e) || ':' || e, '-')) as leaf,
    sha256(coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(b) || ':' || b, '-') || coalesce(strlen(c) || ':' || c, '-') || coalesce(strlen(d2) || ':' || d2, '-') || coalesce(strlen(e) || ':' || e, '-')) as altered from f
), p as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by coalesce('=' || lang, '')) - 1 as g, case when hit then altered else leaf end as now from l
), t as (
  select 0 as level, g, pos, leaf as h, count(*) over (partition by g) as n from p
  union all
  select level + 1, g, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from t where n > 1 group by level, g, pos // 2
), subs as (
  select g, h as subroot, level as top from t where n = 1
), s as (
  select 0 as level, g as pos, subroot as h, count(*) over () as n from subs
  union all
  select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from s where n > 1 group by level, pos // 2
), w as (
  select doc_id, g, pos, 0 as level, now as h, '' as proof from p
  union all
  select w.doc_id, w.g, w.pos, w.level + 1, case when t.h is null then sha256(w.h) when (w.pos >> w.level) % 2 = 1 then sha256(t.h || w.h) else sha256(w.h || t.h) end, w.proof || coalesce(t.h, '')
  from w join subs on subs.g = w.g and w.level < subs.top left join t on t.g = w.g and t.level = w.level and t.pos = xor(w.pos >> w.level, 1)
), m as (
  select w.doc_id, w.g, w.pos, w.h, w.proof from w join subs on subs.g = w.g and subs.top = w.level
), v as (
  select doc_id, g, pos, 0 as level, h, proof from m
  union all
  select v.doc_id, v.g, v.pos, v.level + 1, case when s.h is null then sha256(v.h) when (v.g >> v.level) % 2 = 1 then sha256(s.h || v.h) else sha256(v.h || s.h) end, v.proof || coalesce(s.h, '')
  from v left join s on s.level = v.level and s.pos = xor(v.g >> v.level, 1) where v.level < (select max(level) from s)
)
select p.doc_id, p.leaf, subs.subroot, r.h as root, sha256(v.proof) as proof_sha256, v.h as folded_root, v.h = r.h as verified
from p join subs using (g) join v on v.g = p.g and v.pos = p.pos and v.level = (select max(level) from s) cross join (select h from s where n = 1) r
"""
