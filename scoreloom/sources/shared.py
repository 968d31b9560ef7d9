"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame, written below spark.checkpoint.dir and read back: lineage ends here, lost executors don't matter.

    Where the setting is absent, a local session gets a folder below /tmp/checkpoints; a cluster raises.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
