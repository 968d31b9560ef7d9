"""The pipeline against plain Python, stage by stage."""

import corpus_pipeline
import public_tokenizers as P
import sentencepiece

from tests.llm.test_jaccard import brute
from tests.llm.test_native import base_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    from scoreloom.llm.common import materialise

    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialise(stage(spark, frames[-1], SF), "test-stage"))
    assert all(f.columns == columns for f in frames[:5])
    rows = [[(r["doc_id"], r["text"]) for r in f.collect()] for f in frames[:5]]
    assert 0 < len(rows[1]) < len(rows[0]) and set(rows[1]) <= set(rows[0])
    heads = {c for _, _, c in brute(rows[1], 5, 80)}
    assert sorted(k for k, _ in rows[2]) == sorted(heads)
    before = dict(rows[2])
    for k, t in rows[3]:
        if not base_spans(before[k]) and "[SECRET]" not in t:
            assert t == before[k]
        assert not base_spans(t)
    assert {k for k, _ in rows[4]} <= {k for k, _ in rows[3]}
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted((k, lib.encode(t)) for k, t in rows[4])
    assert sorted((r["doc_id"], list(r["ids"])) for r in frames[5].collect()) == want


def test_near_copies_between_the_bounds_go(spark):
    """A text with a fifth of it appended (similarity 0.83) is a near copy here; one with a third isn't."""
    text = " ".join(f"w{i}" for i in range(1000))
    more = text + " " + " ".join(f"x{i}" for i in range(200))
    other = " ".join(f"y{i}" for i in range(900))
    rows = [(1, text), (2, more), (3, other), (4, other + " " + " ".join(f"z{i}" for i in range(300)))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == sorted({c for _, _, c in brute(rows, 5, 80)}) == [1, 3, 4]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns) and got.count() > 0
