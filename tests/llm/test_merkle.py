"""Operator 13 against trees built level by level."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import merkle as M


def H(*x):
    return sha256("".join(x).encode()).hexdigest()


def leaf(r, more=0):
    values = (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at, now):
    """Siblings and the digest that a changed leaf gives."""
    siblings = []
    for level in levels[:-1]:
        pair = level[at // 2 * 2 : at // 2 * 2 + 2]
        siblings += pair[: at % 2] + pair[at % 2 + 1 :]
        pair[at % 2] = now
        now, at = H(*pair), at // 2
    return siblings, now


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            low, now = climb(trees[g], at, leaf(r, int(hit)))
            high, now = climb(top, k, now)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], H(*low, *high), now, now == top[-1][0]))
    return sorted(out, key=str)


def query_rows(spark, df, monkeypatch):
    monkeypatch.setattr(M, "documents", lambda spark, sf_dir: df)
    return sorted((tuple(r) for r in M.op13_merkle(spark, "").collect()), key=str)


@pytest.mark.parametrize("height", [10, 2])
def test_query(spark, odd, clashing, empty, documents, monkeypatch, height):
    """With blocks of 4 leaves the trees take several traversals."""
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "BLOCK", 1 << height)
    for df in (odd, clashing, documents):
        got = query_rows(spark, df, monkeypatch)
        assert got == brute([r.asDict() for r in df.collect()])
        assert any(not r[-1] for r in got)
    assert query_rows(spark, empty, monkeypatch) == []


def test_many_groups_and_one_large_one(spark, monkeypatch):
    """More groups than a block: their paths are joined, not sent to every task; one group holds a third of the rows."""
    monkeypatch.setattr(M, "HEIGHT", 3)
    monkeypatch.setattr(M, "BLOCK", 8)
    lang = F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.concat(F.lit("g"), (F.col("doc_id") % 17).cast("string")))
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("source"), F.col("id").alias("n_chars")).withColumn("lang", lang)
    assert query_rows(spark, df, monkeypatch) == brute([r.asDict() for r in df.collect()])


def test_proofs_fold_and_forged_ones_do_not(spark):
    df = spark.range(70).select("id", (F.col("id") % 2).cast("string").alias("g"))
    rows = M.manifest(df, "g", "id", [F.col("id")]).collect()
    for r in rows:
        d = bytes.fromhex(r["leaf"])
        assert M.fold(d, r["proof"]).hex() == r["root"] == r["folded_root"] and r["verified"] and r["tree"] == str(r["id"] % 2)
        assert M.fold(M.node(d), r["proof"]).hex() != r["root"]
        assert r["leaf"] == H(f"{len(str(r['id']))}:{r['id']}")
