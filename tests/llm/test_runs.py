"""Operator 12 against runs found by comparing all words some distance apart."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every period: maximal stretches in which words that far apart agree; a smaller period of the same stretch wins."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i + q - a
            if length >= max(6, 4 * q) and not any(s <= a and a + length <= s + m and q % p == 0 for s, m, p in found.values()):
                found[a, q] = (a, length, q)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def changed(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = changed(WORD.findall(text or ""), doc_id)
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=60) | st.lists(st.tuples(st.text("abcd", min_size=1, max_size=6), st.integers(1, 9)), max_size=5).map(lambda x: [c for s, k in x for c in s * k]))
def test_any_words(words):
    assert P.runs_of([w.encode() for w in words]) == brute_runs(words)


def test_long_texts():
    rng = random.Random(3)
    for n, kinds in ((3000, 2), (2000, 3), (4000, 500)):
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        at = rng.randrange(n // 2)
        words[at : at + 900] = (words[at : at + 37] * 30)[:900]
        assert P.runs_of([w.encode() for w in words]) == brute_runs(words)
    many = [b"a"] * 300_000  # one run of one word, and a long period, in seconds
    assert P.runs_of(many) == [(0, 300_000, 1)]
    period = [str(i).encode() for i in range(20_000)]
    assert P.runs_of(period * 5) == [(0, 100_000, 20_000)]


def query_rows(spark, df, monkeypatch):
    monkeypatch.setattr(P, "documents", lambda spark, sf_dir: df)
    return sorted((tuple(r) for r in P.op12_periodic_runs(spark, "").collect()), key=str)


def test_query(spark, odd, clashing, empty, documents, monkeypatch):
    hard = spark.createDataFrame([(i, " ".join(["x y", "x\tx", "z"][i % 3] for _ in range(i))) for i in range(60)] + [(100, "a a a a a a\n" * 3 + "b"), (101, "ä ä ä ä ä\x0bä"), (None, "q " * 9)], "doc_id long, text string")
    for df in (odd, clashing, documents, hard):
        small = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = query_rows(spark, df, monkeypatch)
        known = [brute_row(*r) for r in small if len(r[1] or "") < 20_000]
        assert [x for x in got if x in set(known)] == sorted(known, key=str)
        assert len(got) == len(small)
    assert query_rows(spark, empty, monkeypatch) == []
    assert [f.dataType.simpleString() for f in P.op12_periodic_runs(spark, "").schema][1:6] == ["bigint"] * 5


def test_outputs(spark):
    df = spark.createDataFrame([(1, "go " * 7 + "now"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in P.periodic_runs(df).collect()}
    assert got == {1: ([(0, 7, 1)], "go now"), 2: ([], "")}
