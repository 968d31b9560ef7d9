"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of texts that go to a Python worker at once. By rows alone (10,000) a batch takes tens of MB, several times over
#: in an executor: while it is filled, sent and read.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session (as in tests) gets one below /tmp/checkpoints; a cluster,
    whose machines share no such folder, raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs started herein run with that setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Jobs started herein send Python workers batches of BATCH_BYTES, or of one row where that is longer."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors.

    What the write has shuffled goes with its end, not when the driver happens to collect its garbage.
    """
    path = shared_folder(df.sparkSession, what)
    with small_batches(df.sparkSession), setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separators; null text has none.

    Texts whose only separators are spaces and newlines take the cheaper way, a split by one literal.
    """
    t = F.coalesce(text, F.lit(""))
    rare = t.contains("\t") | t.contains("\r") | t.contains("\x0b") | t.contains("\x0c")
    parts = F.when(rare, F.split(t, SPACE_CLASS + "+")).otherwise(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " "))
    return F.array_remove(parts, "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder
