"""N-gram Jaccard join: near-duplicate documents by exact set overlap, and their components.

The documents' sets of word n-grams are the rows of a sparse 0/1 matrix; overlaps are entries of its
product with its transpose. The product is taken in blocks, and only where an entry can reach its bound:
two sets of sizes a and b reach similarity s only with an overlap of s / (1 + s) * (a + b) or more.

1. Equal sets form a class; from here on only one document of each class counts.
2. n-grams are ordered: frequent ones (repeated passages, boilerplate) behind all others, the rest by hash.
   Frequent is what more than SMALL documents of the whole table hold (equal sets of one part of a scan
   count once). The counts are added up by a shuffle of parts of hashes; up to BROADCAST_GRAMS frequent ones go to every task.
   Of more of them a bit map does; what is in it goes behind the rest, and where that reaches into a set's prefix, they meet the set's
   n-grams in a join. The order affects the cost, never the result. A set's prefix are its first
   |A| - ceil(s |A|) + 1 n-grams; sets that reach s share one in their prefixes.
3. Documents are gathered by prefix n-gram. In a small gathering every pair within the size bounds (total
   sizes, and what can still follow the shared n-gram in both orders) is a candidate. In a large one, as
   large groups of near copies cause, first `leaders` of its documents are paired with all.
4. Candidates are dealt into blocks of documents (by the smallest document of their gathering, large
   ones split by hash of the smaller document of a pair, or of the larger one where the smaller has
   too many pairs for a block); in a block the overlap counts of a document with all others are accumulated
   through the block's inverted index and pairs below the bound are dropped.
5. The links found make components. In large gatherings, pairs across two components are still open. Where at
   most SMALL documents are outside the most common component, those are paired with all that are not in their
   own. Elsewhere, as in groups of near copies that differ too much from the leaders, sets are compared by what
   they differ in from the gathering's middle (see `close`): copies of one text share nearly all n-grams but hardly
   any difference. The pairs left are counted as in 4, and the links of both rounds give the components.

So no link between different components is lost, and a group of copies or near copies never meets itself
pair by pair. Nothing of the corpus goes to the driver but counts and at most BROADCAST_GRAMS hashes or that bit map.
Documents that all hold one passage have it behind their prefixes and aren't gathered by it, unless more than
the similarity's share of a text is made of frequent n-grams. The pairs of step 5 can still grow with the
square of a gathering of such texts where many share their differences from its middle too and yet are not alike.

Defined results: null and empty texts have empty sets and are linked with nothing (component: their own
id); rows that share an id count as one node with the links of all; a null id is a node of its own and
has no component id but null. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise
from .components import components
from .shingles import shingle_sets

SMALL = 24
LEADERS = 20
#: So many of a document's large gatherings, its largest, take part in that.
LARGEST = 2
#: Documents of a gathering that get one copy of its middle.
PART = 1000
#: Pairs that a block should hold at most, about; so many shingles of a pair count as one more.
BLOCK_PAIRS = 1000
PAIR_SHINGLES = 4000
#: Up to so many frequent n-grams (8 bytes each) are sent to every task; of more a bit map of FILTER_BITS, which takes as much.
BROADCAST_GRAMS = 500_000
FILTER_BITS = 25
#: n-grams are counted by the first bits of their hashes: a bucket's and three bytes more. Two of one key count as one,
#: which puts some in vain behind others and becomes common from some 3 TB of text on.
BUCKET_BITS = 12
KEY_BITS = BUCKET_BITS + 24
#: n-grams of a scan that are sorted and sent to be counted at once.
COUNTED = 1_000_000


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frequent(docs: DataFrame, width: int) -> DataFrame:
    """Keys (first KEY_BITS of the hash) of n-grams that more than SMALL documents hold: (bucket, keys, bits).

    A row has a bucket's keys, and its part of a bit map of them of FILTER_BITS. Counted over the whole table: a scan sends
    the sorted keys of many texts, three bytes each, to their buckets.
    """
    per_bucket = FILTER_BITS - BUCKET_BITS

    def dealt(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(sets)) >> np.uint64(64 - KEY_BITS)
        edges = np.searchsorted(keys, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(24))
        held = np.flatnonzero(np.diff(edges))
        low = np.ascontiguousarray(keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
        offsets = 3 * np.append(edges[held], len(keys)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(low)])], ["bucket", "keys"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, n = set(), [], 0
        for batch in _batches(batches):
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                key = hash(s.tobytes())
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    n += len(s)
            if n >= COUNTED:
                yield dealt(sets)
                seen, sets, n = set(), [], 0
        if sets:
            yield dealt(sets)

    def counted(bucket: int, parts: list[bytes]) -> tuple[int, np.ndarray, bytes]:
        three = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 3)
        low = np.zeros((len(three), 4), np.uint8)
        low[:, :3] = three
        keys, n = np.unique(low.view("<u4").ravel(), return_counts=True)
        keys = keys[n > SMALL].astype(np.int64)
        bits = np.zeros(1 << per_bucket, bool)
        bits[keys >> (24 - per_bucket)] = True
        return bucket, keys + (bucket << 24), np.packbits(bits).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            bucket, keys, bits = counted(at, parts)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([bits], pa.binary())], ["bucket", "keys", "bits"])

        for batch in batches:
            for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at:
                    if parts:
                        yield from done()
                    at, parts = bucket, []
                parts.append(part)
        if parts:
            yield from done()

    sent = docs.select("text").mapInArrow(scan, "bucket int, keys binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "bucket int, keys array<bigint>, bits binary")


def late_by(often: DataFrame, few: bool) -> Callable[[np.ndarray], np.ndarray]:
    """Which n-grams go behind the others: those of the given keys, or all whose bit is set (some more than those)."""
    if few:
        known = np.sort(np.concatenate([np.zeros(0, np.int64), *(r["keys"] for r in often.select("keys").collect())])).astype(np.uint64)
    else:
        known = np.zeros((1 << BUCKET_BITS, 1 << FILTER_BITS - BUCKET_BITS - 3), np.uint8)
        for r in often.select("bucket", "bits").collect():
            known[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
        known = known.ravel()
    shift, most = np.uint64(64 - (KEY_BITS if few else FILTER_BITS)), len(known) - 1

    def late(s: np.ndarray) -> np.ndarray:
        x = s >> shift
        if not few:
            return known[x >> np.uint64(3)] << (x & np.uint64(7)).astype(np.uint8) & 128 > 0
        return known[np.minimum(np.searchsorted(known, x), most)] == x if most >= 0 else np.zeros(len(s), bool)

    return late


def least_common(n: int, percent: int) -> int:
    """Smallest overlap of a set of n that can reach the similarity (with any partner)."""
    return -(-percent * n // 100)


def prefixes(docs: DataFrame, late: Callable[[np.ndarray], np.ndarray], width: int, percent: int, whole: bool = False) -> DataFrame:
    """(id, n, class_key, grams): set size, a digest of the set and its prefix in order.

    `whole`: late ones are in no order yet, and sets whose prefix holds some of them are given whole.
    """
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            sizes, keys, grams = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n = len(s)
                first = n - least_common(n, percent) + 1 if n else 0
                sizes.append(n)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                behind = late(s)
                early = s[~behind]
                s = np.concatenate((early, s[behind]))
                grams.append((s if whole and len(early) < first else s[:first]).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["id", "n", "class_key", "grams"])

    return docs.select("id", "text").mapInArrow(work, "id bigint, n bigint, class_key binary, grams array<bigint>")


def joined_prefixes(sets: DataFrame, heads: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """(id, n, grams): the prefixes of the classes' first documents where the frequent n-grams are too many for every task.

    `heads` are the (class_key, id) of the first documents. Only their sets that are given whole, as few others
    than those in the bit map are in them, meet the frequent n-grams in a join; copies and repeated rows don't take part.
    """
    first = (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1).cast("int")
    one = sets.join(heads, ["class_key", "id"], "left_semi").dropDuplicates(["class_key"])
    common = often.select(F.explode("keys").alias("key"), F.lit(True).alias("late"))
    grams = one.filter(F.size("grams") > first).select("class_key", F.posexplode("grams").alias("at", "gram")).withColumn("key", F.shiftrightunsigned("gram", 64 - KEY_BITS))
    # those in the bit map alone stay before the frequent ones
    key = F.struct(F.coalesce("late", F.lit(False)).alias("late"), "at", "gram")
    ordered = grams.join(common, "key", "left").groupBy("class_key").agg(F.sort_array(F.collect_list(key))["gram"].alias("ordered"))
    return one.join(ordered, "class_key", "left").select("id", "n", F.slice(F.coalesce("ordered", "grams"), F.lit(1), first).alias("grams"))


def can_reach(a: str, b: str, percent: int) -> Column:
    """Size bounds of two gathered rows (columns id, n, at under these prefixes), the n-gram being the first shared."""
    na, nb, ia, ib = (F.col(f"{x}.{c}") for x, c in ((a, "n"), (b, "n"), (a, "at"), (b, "at")))
    most = F.least(na - ia, nb - ib)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def some_of(rows: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """Of each group up to LEADERS rows, by hashes of their ids: (by, *columns)."""
    least = rows.groupBy(by).agg(*[F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), *columns)).alias(f"l{r}") for r in range(LEADERS)])
    each = [F.struct(*[F.col(f"l{r}.{c}") for c in columns]) for r in range(LEADERS)]
    return least.select(by, F.explode(F.array_distinct(F.array(*each))).alias("l")).select(by, "l.*")


def middles(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(home, picks, often): of some documents that hold the home's largest gathering, the n-grams that more than a quarter hold.

    `often` has structs of an n-gram and how many of the `picks` sets hold it. The choice affects the cost, never the result.
    """
    top = rows.groupBy("home").agg(F.max(F.struct("m", "gram"))["gram"].alias("gram"))
    picks = some_of(rows.join(top, ["home", "gram"]), "home", ("id",))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            for home, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), width), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["home", "grams"])

    sets = materialise(picks.hint("merge").join(texts, "id").select("home", "text").mapInArrow(work, "home bigint, grams array<bigint>"), "picks")
    many = sets.groupBy("home").agg(F.count(F.lit(1)).alias("picks"))
    held = sets.select("home", F.explode("grams").alias("gram")).groupBy("home", "gram").agg(F.count(F.lit(1)).alias("held"))
    return held.join(many, "home").filter("4 * held > picks").groupBy("home", "picks").agg(F.collect_list(F.struct("gram", "held")).alias("often"))


def differences(members: DataFrame, rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(home, id, c, most, reach, n, d, grams): each member's set size, and its symmetric difference with the home's middle.

    The middle are the n-grams that more than half of the picked sets hold; `d` is the size of the difference,
    `grams` the part of it that can matter (see `close`), what fewer of the picked sets differ in first.
    """
    parts = F.ceil(F.col("k") / PART)
    sizes = members.groupBy("home").agg(F.count(F.lit(1)).alias("k"))
    centre = middles(rows, texts, width).join(sizes, "home").select("home", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), "picks", F.col("often.gram").alias("gram"), F.col("often.held").alias("held"))
    dealt = members.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("k")
    whole = dealt.hint("merge").join(texts, "id").join(centre, ["home", "part"]).select("home", "id", "c", "most", "reach", "text", "picks", "gram", "held")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 100):
            homes, known, at, sizes, ds, grams = batch.column(0).to_pylist(), {}, [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column(5).to_pylist(), width)):
                n = len(s)
                if not n:
                    continue
                if homes[i] not in known:
                    g, h = batch.column(7)[i].values.to_numpy().view(np.uint64), batch.column(8)[i].values.to_numpy()
                    by, picks = np.argsort(g), batch.column(6)[i].as_py()
                    known[homes[i]] = g[by], np.where(2 * h > picks, picks - h, h)[by], (2 * h > picks)[by]
                g, weight, middle = known[homes[i]]
                place = np.minimum(np.searchsorted(g, s), len(g) - 1)
                met = g[place] == s
                differs = middle.copy()
                differs[place[met]] ^= True
                other, w = g[differs], weight[differs]
                ordered = np.concatenate((s[~met], other[np.lexsort((other, w))]))
                d = len(ordered)
                # a partner has at most 100 n / percent n-grams, and a difference of none or more
                k = -(-((100 + percent) * d - (100 - percent) * (n + 100 * n // percent)) // (2 * (100 + percent)))
                at.append(i)
                sizes.append(n)
                ds.append(d)
                grams.append(ordered[: d - max(1, k) + 1].view(np.int64))
            kept = batch.select(["home", "id", "c", "most", "reach"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), pa.array(ds, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], ["home", "id", "c", "most", "reach", "n", "d", "grams"])

    return whole.mapInArrow(work, "home bigint, id bigint, c bigint, most bigint, reach bigint, n bigint, d bigint, grams array<bigint>").distinct()


def close(members: DataFrame, rows: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and gathered rows x and y whose pairs, with those links, hold all links across components of a home.

    Be D the symmetric difference of a set with any fixed set, r = (100 + percent) |D| - (100 - percent) n. Two sets
    reach the similarity where r + r' <= 2 (100 + percent) q, q being the size of the intersection of their Ds. So with
    the least r of a home, all that need no q at all are linked to one document. Any other linked pair shares an
    element of its Ds, among the first |D| - k + 1 of both where q must be k or more. `reach` bounds what a member
    shares with any other that it first meets in this home.
    """
    unit = 2 * (100 + percent)
    sets = materialise(differences(members, rows, texts, width, percent), "differences").withColumn("r", (100 + percent) * F.col("d") - (100 - percent) * F.col("n"))
    least = sets.groupBy("home").agg(F.min(F.struct("r", "id")).alias("z")).select("home", F.col("z.r").alias("r0"), F.col("z.id").alias("centre"))
    sets = sets.join(least, "home").withColumn("sure", F.col("r") + F.col("r0") <= 0)
    links = sets.filter("sure and id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    # the components that those links join are one, or the most common one where that is larger
    parts = sets.groupBy("home", "c", "most").agg(F.count(F.lit(1)).alias("k"), F.max("sure").alias("star"))
    larger = parts.groupBy("home").agg(F.sum(F.when(F.col("star"), F.col("k")).otherwise(0)).alias("s"), F.sum(F.when(F.expr("c = most"), F.col("k")).otherwise(0)).alias("l"))
    inside = parts.join(larger, "home").select("home", "c", F.when(F.expr("s >= l"), F.col("star")).otherwise(F.expr("c = most")).alias("inside"))
    sets = sets.join(inside, ["home", "c"])
    sets = sets.join(sets.filter("not inside").groupBy("home").agg(F.min("r").alias("r1")), "home")

    def first(some: DataFrame, bound: str) -> DataFrame:
        k = F.greatest(F.lit(1), F.ceil((F.col("r") + F.col(bound)) / unit))
        return some.select("home", "id", "c", "reach", "n", "d", "r", F.posexplode(F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.col("d") - k + 1).cast("int"))).alias("at", "gram"))

    x, y = first(sets.filter("not inside"), "r0").alias("x"), first(sets, "r1").alias("y")
    fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * F.least("x.reach", "y.reach") >= percent * (F.col("x.n") + F.col("y.n")))
    enough = F.col("x.r") + F.col("y.r") <= unit * F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
    return links, x.join(y, (F.col("x.home") == F.col("y.home")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.c") != F.col("y.c")) & fits & enough)


def blocks(pairs: DataFrame) -> DataFrame:
    """Candidates (home, block, salt, a, b), about BLOCK_PAIRS of them in a block and salt.

    Pairs are dealt by b. Those of a b with more than BLOCK_PAIRS pairs, as leaders have, are dealt by a, and
    by both where that a has as many of such pairs. A pair with a column `w` counts as so many, so that pairs
    of long texts make smaller blocks.
    """
    pairs = pairs if "w" in pairs.columns else pairs.withColumn("w", F.lit(1.0))
    n = F.sum("w")
    wide = pairs.groupBy("home", "b").agg(n.alias("k")).filter(F.col("k") > BLOCK_PAIRS).select("home", "b", F.lit(True).alias("wide"))
    marked = pairs.select("home", "a", "b", "w").join(wide, ["home", "b"], "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    counts = marked.groupBy("home", "wide").agg(n.alias("m"))
    steep = marked.filter("wide").groupBy("home", "a").agg(n.alias("k")).filter(F.col("k") > BLOCK_PAIRS).withColumn("wide", F.lit(True))
    split = marked.join(counts, ["home", "wide"]).join(steep, ["home", "a", "wide"], "left")
    block = F.pmod(F.when(F.col("wide"), F.xxhash64("a")).otherwise(F.xxhash64("b")), F.ceil(F.col("m") / BLOCK_PAIRS))
    salt = F.when(F.col("wide"), 1 + F.pmod(F.xxhash64("b", F.lit(1)), F.ceil(F.coalesce("k", F.lit(1.0)) / BLOCK_PAIRS))).otherwise(F.lit(0))
    return split.select("home", block.alias("block"), salt.cast("bigint").alias("salt"), "a", "b")


def overlaps(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) among candidates (a, b, home) that reach the similarity."""
    dealt = materialise(blocks(pairs), "candidates")
    needed = dealt.select("home", "block", "salt", F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = needed.hint("merge").join(docs, "id").select("home", "block", "salt", "id", "text")
    rows = sets.select("home", "block", "salt", F.lit(0).alias("kind"), "id", F.lit(None).cast("bigint").alias("b"), "text").unionByName(dealt.select("home", "block", "salt", F.lit(1).alias("kind"), F.col("a").alias("id"), "b", F.lit(None).cast("string").alias("text")))

    def work(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        is_set = kinds == 0
        texts = group.filter(pa.array(is_set))
        ids = texts.column("id").to_numpy()
        rows_, lengths = [], []
        for s in shingle_sets(texts.column("text").to_pylist(), width):
            rows_.append(s)
            lengths.append(len(s))
        # rows that share an id are one node: each of its sets is a row of its own
        lengths = np.array(lengths)
        asked = group.filter(pa.array(~is_set))
        left, right = asked.column("id").to_numpy(), asked.column("b").to_numpy()
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        grams, owner = np.concatenate(rows_), np.repeat(np.arange(len(rows_)), lengths)
        by = np.argsort(grams, kind="stable")
        grams, owner = grams[by], owner[by]
        out_a, out_b = [], []
        want: dict[int, list[int]] = {}
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            want.setdefault(x, []).append(y)
        for x, ys in want.items():
            lo, hi = np.searchsorted(sorted_ids, [x, x + 1]) if x < (1 << 63) - 1 else (np.searchsorted(sorted_ids, x), len(sorted_ids))
            for i in order[lo:hi]:
                first, last = np.searchsorted(grams, rows_[i], "left"), np.searchsorted(grams, rows_[i], "right")
                spread = last - first
                take = np.repeat(first - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
                shared = np.bincount(owner[take], minlength=len(rows_))
                good = (100 * shared >= percent * (lengths[i] + lengths - shared)) & (shared > 0)
                linked = set(ids[good].tolist())
                for y in ys:
                    if y in linked:
                        out_a.append(x)
                        out_b.append(y)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.groupBy("home", "block", "salt").applyInArrow(work, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, class_id (smallest id with an equal set), component_id."""
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    often = materialise(frequent(docs, width), "frequent")
    few = (often.agg(F.sum(F.size("keys"))).first()[0] or 0) <= BROADCAST_GRAMS
    sets = materialise(prefixes(docs, late_by(often, few), width, percent, whole=not few), "prefixes")
    classes = sets.filter("n > 0 and id is not null").groupBy("class_key").agg(F.min("id").alias("class_id"))
    of_class = materialise(sets.select("id", "n", "class_key").join(classes, "class_key", "left").select("id", "n", F.coalesce("class_id", "id").alias("class_id")), "classes")
    heads = classes.select("class_key", F.col("class_id").alias("id"))
    first_rows = sets.join(heads, ["class_key", "id"], "left_semi") if few else materialise(joined_prefixes(sets, heads, often, percent), "first-prefixes")
    chosen = first_rows.select("id", "n", F.posexplode("grams").alias("at", "gram"))
    gathered = chosen.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("home")).filter("m > 1")
    rows = materialise(chosen.join(gathered, "gram").select("gram", "m", "home", "id", "n", "at"), "gathered")
    small, large = rows.filter(F.col("m") <= SMALL), rows.filter(F.col("m") > SMALL)
    near = small.alias("x").join(small.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")) & can_reach("x", "y", percent))
    # Near copies share most gatherings; a few of them do, as step 5 still looks at all.
    main_rows = large.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("m"), "gram"))).filter(F.col("_k") <= LARGEST).drop("_k")
    lead = some_of(main_rows, "gram", ("id", "n", "at"))
    far = main_rows.alias("x").join(lead.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") != F.col("y.id")) & can_reach("x", "y", percent))

    def asked(joined: DataFrame) -> DataFrame:
        return joined.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"), F.col("x.home").alias("home"), (1 + (F.col("x.n") + F.col("y.n")) / PAIR_SHINGLES).alias("w"))

    first = asked(near).unionByName(asked(far)).groupBy("a", "b").agg(F.min("home").alias("home"), F.max("w").alias("w"))
    first = materialise(first, "pairs")
    asked_for = first.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct()
    # The ids grow with the corpus, so they are never broadcast; only these texts move, once.
    texts = materialise(docs.join(asked_for.hint("merge"), "id", "left_semi"), "texts")
    # the classes of one id are one node
    several = of_class.filter("n > 0 and id is not null").groupBy("id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo < hi")
    tied = of_class.join(several, "id").filter("n > 0").select(F.col("class_id").alias("a"), F.col("lo").alias("b")).filter("a != b").distinct()
    links = materialise(overlaps(texts, first, width, percent).unionByName(tied), "links")
    found = materialise(components(links, "a", "b"), "components")
    # pairs across components of large gatherings
    labelled = large.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    # Gatherings with the same smallest document share most others too; they are taken together, with
    # the earliest place of an n-gram, which bounds the overlap from above.
    placed = labelled.groupBy("home", "id", "n", "c").agg(F.min("at").alias("at"))
    main = placed.groupBy("home", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("home").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"))
    main = main.select("home", F.col("top.c").alias("most"), (F.col("k") - F.col("top.k")).alias("open")).filter("open > 0")
    labelled = materialise(placed.join(main, "home"), "labelled")
    some, many = labelled.filter(F.col("open") <= SMALL), labelled.filter(F.col("open") > SMALL)
    across = some.filter("c != most").alias("x").join(some.alias("y"), (F.col("x.home") == F.col("y.home")) & (F.col("x.c") != F.col("y.c")) & can_reach("x", "y", percent))
    members = many.groupBy("home", "id", "c", "most").agg(F.max(F.col("n") - F.col("at")).alias("reach"))
    certain, apart = close(members, large.join(members.select("home").distinct(), "home", "left_semi"), texts, width, percent)
    second = asked(across).unionByName(asked(apart)).groupBy("a", "b").agg(F.min("home").alias("home"), F.max("w").alias("w")).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = materialise(second, "pairs")
    more = materialise(overlaps(texts, second, width, percent).unionByName(certain), "links")
    joined = more.join(found.selectExpr("node as a", "component as ca"), "a", "left").join(found.selectExpr("node as b", "component as cb"), "b", "left")
    merged = materialise(components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b"), "components")
    final = found.selectExpr("node", "component as c1").join(merged.selectExpr("node as c1", "component as c2"), "c1", "left").select("node", F.coalesce("c2", "c1").alias("component"))
    fresh = merged.selectExpr("node", "component").join(found.select("node"), "node", "left_anti")
    labels = final.unionByName(fresh)
    done = of_class.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(documents(spark, sf_dir))


OP3_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) end as g from w
), classes as (
  select doc_id, g, len(g) as n, case when len(g) = 0 then doc_id else min(doc_id) over (partition by g) end as class_id from sets
), grams as (
  select doc_id, n, unnest(g) as gram from classes where doc_id = class_id and n > 0
), links as (
  select a.doc_id as a, b.doc_id as b from grams a join grams b on a.gram = b.gram and a.doc_id != b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), reach as (
  select distinct class_id as x, class_id as y from classes union select r.x, l.b from reach r join links l on l.a = r.y
), low as (
  select x, min(y) as component_id from reach group by x
)
select doc_id, cast(n as bigint) as n_shingles, class_id, component_id from classes join low on x = class_id
"""
