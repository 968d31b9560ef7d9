"""Corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm import jaccard_join, mixing, piece_bpe, quality_rules, secret_scan
from scoreloom.llm.common import documents, materialise

#: SQL can't express the last stage (exact piece encoding); tests/llm compares all stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id stays, once.

    Near copies share 0.8 or more of their 5-word shingles; op3's 4 words and 0.85 are that query's own.
    Rows without an id can't be told apart and all stay.
    """
    groups = jaccard_join.near_duplicates(docs, width=5, percent=80)
    heads = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_head")).distinct()
    rows = docs.join(heads, F.col("doc_id") == F.col("_head"), "left_semi")
    first = rows.withColumn("_nth", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).filter("_nth = 1").select(*docs.columns)
    return first.unionByName(docs.filter(F.col("doc_id").isNull()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked in its text."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from not at all to twice."""
    return mixing.mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of them and of the text decoded from them."""
    return piece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scan", secrets), ("mixing", mix), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over a folder's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
