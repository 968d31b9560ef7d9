"""Operator 3 against all pairs, with large groups of copies and near copies."""

import random
import re
from collections import Counter

import pytest

from scoreloom.llm import jaccard_join as J
from scoreloom.llm.components import components
from scoreloom.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, width=4, percent=85):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if rows[i][0] == rows[j][0] or o and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), k), k)
    return sorted((k, len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows))


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df).collect())


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    rows, k = [], 0
    for size in (1, 2, 3, 5, 8, 30, 90):
        base = [word() for _ in range(r.randint(1, 80))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            rows.append((k, " ".join(copy)))
            k += 1
    for _ in range(60):
        rows.append((k, passage + " " + " ".join(word() for _ in range(r.randint(0, 12)))))
        k += 1
    rows += [(k + i, t) for i, t in enumerate(["same TEXT here now", "Same text here now"] * 20 + ["", "a", "A", "a b", "b a", None, "  "])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    if seed == 1:  # the same with few leaders, small gatherings and small blocks
        monkeypatch.setattr(J, "SMALL", 3)
        monkeypatch.setattr(J, "LEADERS", 1)
        monkeypatch.setattr(J, "BLOCK_PAIRS", 7)
        monkeypatch.setattr(J, "BROADCAST_GRAMS", -1)  # and frequent n-grams by a join
        assert found(df) == brute(rows)


def test_a_shared_phrase_makes_no_pairs(spark, monkeypatch):
    """Documents that are alike only in one phrase are hardly ever paired, however many hold it; scattered over many batches."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    phrase = " ".join(word() for _ in range(20))
    rows = [(i, " ".join([word() for _ in range(40)] + ([phrase] if i % 5 == 0 else []))) for i in range(2000)]
    asked = []
    overlaps = J.overlaps
    monkeypatch.setattr(J, "overlaps", lambda docs, pairs, *a: asked.append(pairs.count()) or overlaps(docs, pairs, *a))
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(40))
    assert got.filter("doc_id != component_id").count() == 0
    assert sum(asked) < 400  # of 79,800 possible ones among the 400 documents with the phrase


@pytest.mark.parametrize("n", [300, 600])
def test_near_copies_far_from_the_leaders_make_few_pairs(spark, n, monkeypatch):
    """A group of near copies of which many are alike with few others: exact, without all pairs across components."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(n):
        copy = list(base)
        for at in r.sample(range(150), i % 9):
            copy[at] = word()
        if i % 40 == 8:  # pairs that are alike beyond the middle
            rows.append((n + i, " ".join(copy[:-1] + [word()])))
        rows.append((i, " ".join(copy)))
    r.shuffle(rows)
    asked = []
    overlaps = J.overlaps
    monkeypatch.setattr(J, "overlaps", lambda docs, pairs, *a: asked.append(pairs.count()) or overlaps(docs, pairs, *a))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and len({c for _, _, c in got}) > n // 3
    assert asked[1] < n  # beyond those with leaders; all across components would be some n * n / 4


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_pairs_across_components_of_mixed_groups(spark, percent, monkeypatch):
    """Near copies of several texts by replaced, lost and added words, repeated rows and clashing identifiers in one gathering."""
    r = random.Random(percent)
    word = lambda: r.choice("abcdefghijkl") + r.choice("mnopq")
    shared, rows = [word() for _ in range(25)], []
    for base in ([word() for _ in range(size)] for size in (30, 31, 45)):
        for _ in range(50):
            copy = shared + base
            for _ in range(r.randint(0, 5)):
                at = r.randrange(len(copy))
                copy[at : at + r.randint(0, 2)] = [word()] * r.randint(0, 2)
            rows.append((r.randrange(300), " ".join(copy)))
    rows += rows[:20] + [(1000, ""), (1001, None)]
    for name, most in (("SMALL", 4), ("LEADERS", 2), ("PART", 7)):
        monkeypatch.setattr(J, name, most)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(rows, percent=percent)


def test_classes_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (8, b), (9, c)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("shape", ["leaders", "star", "all"])
def test_blocks_are_bounded(spark, shape, monkeypatch):
    """A document with many pairs, on either side, doesn't bring them all to one task; no pair is lost or doubled."""
    monkeypatch.setattr(J, "BLOCK_PAIRS", 40)
    pairs = {"leaders": [(a, b, 0) for b in range(3) for a in range(3, 2000)], "star": [(9999, b, 0) for b in range(2000)], "all": [(a, b, 0) for a in range(120) for b in range(a)]}[shape]
    got = J.blocks(spark.createDataFrame(pairs, "a long, b long, home long")).collect()
    assert sorted((r["a"], r["b"], r["home"]) for r in got) == sorted(pairs)
    sizes = Counter((r["home"], r["block"], r["salt"]) for r in got)
    assert max(sizes.values()) <= 6 * 40


@pytest.mark.parametrize("most", [J.BROADCAST_GRAMS, -1])
def test_odd(odd, clashing, empty, most, monkeypatch):
    """Also where frequent n-grams are joined."""
    monkeypatch.setattr(J, "BROADCAST_GRAMS", most)
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None])
    got = J.near_duplicates(clashing).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert J.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [J.BROADCAST_GRAMS, -1])
def test_repeated_rows_stay(spark, most, monkeypatch):
    """Repeated identifiers, texts and nulls, with frequent n-grams sent and joined, and small limits."""
    monkeypatch.setattr(J, "BROADCAST_GRAMS", most)
    rows = [(1, "t"), (1, "t"), (2, "t x"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, None), (None, "t"), (None, "t")]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([r for r in rows if r[0] is not None])
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [r["n_shingles"] for r in got if r["doc_id"] is None] == [1, 1]
    monkeypatch.setattr(J, "SMALL", 2)
    many = corpus(4) * 2 + [(k, t) for k, t in corpus(4)[:9] for _ in range(3)]
    assert found(spark.createDataFrame(many, "doc_id long, text string")) == brute(many)


def test_many_frequent_ngrams_take_little_room(spark, monkeypatch):
    """Where frequent n-grams are too many to be sent, hardly any set is written whole, and the result is that of all pairs."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    phrase, base = " ".join(word() for _ in range(20)), [word() for _ in range(150)]
    rows = [(i, " ".join([word() for _ in range(150)] + ([phrase] if i % 3 == 0 else []))) for i in range(400)]
    for i in range(40):
        copy = list(base)
        copy[r.randrange(150)] = word()
        rows.append((400 + i, " ".join(copy)))
    monkeypatch.setattr(J, "BROADCAST_GRAMS", -1)
    held, materialise = {}, J.materialise

    def watched(df, what):
        out = materialise(df, what)
        if what.endswith("prefixes"):
            held[what] = out.selectExpr("sum(size(grams))").first()[0]
        return out

    monkeypatch.setattr(J, "materialise", watched)
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want
    assert sum(held.values()) < 0.5 * sum(n for _, n, _ in want)


def test_frequent_keys(spark, monkeypatch):
    """Counted exactly over many parts of many scans; the bit map holds all of them, and few more."""
    import numpy as np

    r = random.Random(6)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) + f" {i}" for i in range(600)]
    monkeypatch.setattr(J, "COUNTED", 900)
    often = J.frequent(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3), 4).cache()
    held = Counter(g for s in shingle_sets(texts, 4) for g in s.tolist())
    want = {g >> 64 - J.KEY_BITS for g, n in held.items() if n > J.SMALL}
    got = [k for x in often.collect() for k in x["keys"]]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    every = np.array(sorted(held), np.uint64)
    exact, mapped = (J.late_by(often, few)(every) for few in (True, False))
    assert exact.tolist() == [g >> 64 - J.KEY_BITS in want for g in every.tolist()]
    assert mapped[exact].all() and mapped.sum() < exact.sum() + 0.01 * len(every)
    none = J.late_by(often.filter("false"), True), J.late_by(often.filter("false"), False)
    assert not any(x(every).any() for x in none)


@pytest.mark.parametrize("bits", [15, 25])
def test_a_full_bit_map_changes_no_result(spark, bits, monkeypatch):
    """Sets that meet the frequent n-grams in a join, few and nearly all of them."""
    monkeypatch.setattr(J, "BROADCAST_GRAMS", -1)
    monkeypatch.setattr(J, "FILTER_BITS", bits)
    monkeypatch.setattr(J, "SMALL", 0 if bits == 15 else 1)
    rows = corpus(7)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_what_a_table_shuffled_goes_with_it(spark):
    """Shuffled files don't wait for the driver's garbage to be collected."""
    import time

    from scoreloom.llm import common

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    rows = common.materialise(spark.range(50_000).groupBy(common.F.sha2(common.F.col("id").cast("string"), 256).alias("x")).count(), "shuffled")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and rows.count() == 50_000


def test_shingle_sets():
    texts = ["", None, "a", "A b", "a b c d", "  a\tb\x0bc d e é É ", "a b c d a b c d", "x" * 100_000]
    assert [len(s) for s in shingle_sets(texts, 4)] == [0, 0, 1, 1, 1, 4, 4, 1]
    assert shingle_sets(["A B C D"], 4)[0][0] == shingle_sets(["a b\nc   d"], 4)[0][0]


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(pairs, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_workers_get_texts_in_small_batches(spark, monkeypatch):
    """A batch is bounded in bytes whatever the length of the texts; batches change no result, the session keeps its own setting."""
    import pyarrow as pa

    from scoreloom.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 5000) as text")
    got = common.materialise(texts.mapInArrow(sizes, "n bigint, bytes bigint"), "sizes").collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["bytes"] for r in got) < 1.1 * common.BATCH_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(key, None) is None
    monkeypatch.setattr(common, "BATCH_BYTES", 5000)
    rows = corpus(4)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    spark.conf.set(key, "7000")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(key) == "5000"
        assert spark.conf.get(key) == "7000"
    finally:
        spark.conf.unset(key)


def test_a_waiting_worker_gives_the_piece_model_back():
    import public_tokenizers

    from scoreloom.llm import piece_bpe

    model = piece_bpe.model_of(public_tokenizers.path("piece_bpe_32k.model"))
    before = model.encode("some words here")
    model.rest.forget()
    assert piece_bpe.model_of.cache_info().currsize == 0 and model.encode("some words here") == before
