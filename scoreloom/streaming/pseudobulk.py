"""Pseudobulk means over event time, for cells that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(cells: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """n and mean per event-time window and key; rows later than `late` are dropped by the watermark."""
    return cells.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n_cells"), F.avg(value).alias("mean")).select(F.col("window.start").alias("window_start"), *keys, "n_cells", "mean")
