"""Operators 2 and 10: held-out accuracy on invented texts, and odd inputs."""

import random

import numpy as np
import pytest

from scoreloom.llm import byte_cnn, toxicity
from scoreloom.llm.queries import QUERIES

BAD = ["idiotic", "scumbag", "vermin"]


def prose(r, n=60):
    return [("".join(r.choice(["ka", "lo", "mi", "ter", "su", "ne"]) for _ in range(r.randint(1, 4)))) for _ in range(n)]


def toxic_rows(seed, n=400):
    r, out = random.Random(seed), []
    for i in range(n):
        w = prose(r)
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(BAD)
        out.append((" ".join(w), int(i % 4 == 0)))
    return out


def test_lexicon_on_held_out_rows():
    lexicon = toxicity.fit(toxic_rows(1))
    a = lexicon.automaton()
    assert all(any(e.strip() and b.replace("l", "i").startswith(e.strip()) for e in lexicon.entries) for b in BAD)
    score = lambda t: toxicity.score_of(*toxicity.weighed(toxicity.fold(t), a), lexicon.curve)
    rows = toxic_rows(2)
    assert np.mean([(score(t) >= 0.7) == y for t, y in rows]) > 0.97
    calm, rude = " ".join(prose(random.Random(5))), " ".join([*prose(random.Random(5)), "you 1d10t1c, V3RM1N! sсumbаg"])
    assert score(calm) < 0.7 <= score(rude)


def test_exception_phrase():
    a = toxicity.Lexicon({" vermin ": 3.0}, [" vermin controi "], None).automaton()
    assert toxicity.weighed(toxicity.fold("the vermin control office"), a)[0] == 0
    assert toxicity.weighed(toxicity.fold("the vermin office"), a)[0] == 3.0


def test_matching_equals_plain_search():
    """Entries and exception phrases by str.find at every place."""
    r = random.Random(8)
    words = ["ab", "abc", "abcd", "bad", "badly", "very", "x"]
    for _ in range(300):
        entries = {e: r.uniform(0.5, 3) for e in r.sample([" ab ", " abc", " bad", " bad ", " badi", " x "], 4)}
        exceptions = r.sample([" very bad ", " x ab ", " bad x "], 2)
        text = toxicity.fold(" ".join(r.choice(words) for _ in range(r.randint(0, 60))))
        found = {}
        for e, w in entries.items():
            for i in range(len(text)):
                if text.startswith(e, i):
                    found[i] = max(w, found.get(i, 0.0))
        for e in exceptions:
            for i in range(len(text)):
                if text.startswith(e, i):
                    for k in range(i, i + len(e) - 1):
                        found.pop(k, None)
        got = toxicity.weighed(text, toxicity.Lexicon(entries, exceptions).automaton())
        assert abs(got[0] - sum(found.values())) < 1e-9 and got[1] == text.count(" ")


def test_network_equals_plain_loops():
    """Chunks, filters, maxima and the mean, one window at a time."""
    net, r = byte_cnn.start(3), random.Random(2)
    texts = ["", "short", "é" * 300, "".join(r.choice("abc def") for _ in range(1200))]
    for t, got in zip(texts, byte_cnn.logits(net, texts)):
        raw, hop, outs, at = list(t.encode()), byte_cnn.CHUNK - byte_cnn.OVERLAP, [], 0
        while True:
            part = raw[at : at + byte_cnn.CHUNK]
            part += [256] * (byte_cnn.CHUNK - len(part))
            best = np.full(byte_cnn.FILTERS, -np.inf)
            for w in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
                best = np.maximum(best, np.concatenate([net.embed[b] for b in part[w : w + byte_cnn.WIDTH]]) @ net.filters + net.bias)
            hidden = np.maximum(np.maximum(best, 0) @ net.dense + net.dense_bias, 0)
            outs.append(float(hidden @ net.out + net.out_bias[0]))
            if at + byte_cnn.CHUNK >= len(raw):
                break
            at += hop
        assert abs(got - np.mean(outs)) < 1e-4


def test_long_and_short_texts_score_alike_together_and_alone():
    net, r = byte_cnn.start(4), random.Random(3)
    texts = ["".join(r.choice("abcdefg ") for _ in range(n)) for n in (10, 300_000, 0, 700, 5000)]
    assert np.allclose(byte_cnn.logits(net, texts), [byte_cnn.logits(net, [t])[0] for t in texts], atol=1e-6)


def test_fold():
    assert toxicity.fold("Ｈ3llo, wоrld! 1d10t").split() == ["heiio", "worid", "idiot"]
    assert toxicity.fold("really! a|b").split()[0] == "reaiiy"


def test_no_labels(odd):
    lexicon = toxicity.fit([])
    assert {r["score"] for r in toxicity.score(odd, lexicon).collect()} == {0.0}
    assert byte_cnn.train([("a", 1)]) is None
    assert {r["predicted"] for r in byte_cnn.score(odd, None, only=1.0).collect()} == {1}


def quality_rows(seed, n=300):
    r, out = random.Random(seed), []
    for i in range(n):
        w = prose(r, 120)
        if i % 3 == 0:
            w = [x + r.choice(["###", "%%%", "&&&"]) for x in w]
        out.append((" ".join(w), int(i % 3 != 0)))
    return out


def test_network_on_held_out_rows():
    net = byte_cnn.train(quality_rows(1), steps=150)
    rows = quality_rows(2, 120)
    p = 1 / (1 + np.exp(-byte_cnn.logits(net, [t for t, _ in rows])))
    assert np.mean((p >= 0.3) == np.array([y for _, y in rows])) > 0.95
    assert np.array_equal(byte_cnn.train(quality_rows(1), steps=20).filters, byte_cnn.train(quality_rows(1), steps=20).filters)


def test_chunks_cover_the_text():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        c = byte_cnn.chunks("x" * n)
        assert c.shape[1] == byte_cnn.CHUNK and (c[-1] != 256).sum() >= min(1, n)
        assert (len(c) - 1) * (byte_cnn.CHUNK - byte_cnn.OVERLAP) + byte_cnn.CHUNK >= n


def test_odd_rows(odd, clashing, empty):
    net, lexicon = byte_cnn.train(quality_rows(1), steps=5), toxicity.fit(toxic_rows(1))
    for df in (odd, clashing):
        for got in (byte_cnn.score(df, net).collect(), toxicity.score(df, lexicon).collect()):
            assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    assert byte_cnn.score(empty, net).count() == toxicity.score(empty, lexicon).count() == 0


@pytest.mark.parametrize(("name", "label", "remainder", "modulus"), [("op2_toxicity", "toxic", 1, 3), ("op10_byte_cnn", "quality", 0, 5)])
def test_held_out_accuracy(spark, name, label, remainder, modulus):
    import zlib

    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).collect()
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in rows)
    test = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean([p == y for p, y in test]) > 0.9
