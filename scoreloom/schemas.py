"""Data model: long tables and small validated parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: One row per cohort, sample and gene. Missing values are NULL, never NaN.
EXPRESSION = T.StructType([T.StructField("cohort", T.StringType()), T.StructField("sample_id", T.StringType()), T.StructField("gene", T.StringType()), T.StructField("gene_ord", T.IntegerType()), T.StructField("value", T.DoubleType())])
#: Frozen weights; `ord` is the order of the file, which decides what is kept first.
WEIGHTS = T.StructType([T.StructField("module_label", T.StringType()), T.StructField("gene", T.StringType()), T.StructField("loading", T.DoubleType()), T.StructField("ord", T.IntegerType())])


@dataclass(frozen=True)
class ScoringRule:
    """Coverage a program needs before it is scored; both bounds are inclusive."""

    mapping_name: str = "strict"
    minimum_genes: int = 3
    minimum_fraction: float = 0.5

    def __post_init__(self):
        if self.minimum_genes < 1:
            raise ValueError("minimum_genes must be at least 1")
        if not 0 <= self.minimum_fraction <= 1:
            raise ValueError("minimum_fraction must lie between 0 and 1")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself; raises with the sorted missing names."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
