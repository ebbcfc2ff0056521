"""Reading of pair tables and preference sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load_split(spark: SparkSession, path: str, split: str | None = None, kind: str = "parquet") -> DataFrame:
    """A dataset, or the split of it named by the partition column ``split``."""
    df = spark.read.format(kind).load(path)
    return df if split is None else df.where(F.col("split") == split)


def of_task(df: DataFrame, task: str, column: str = "task") -> DataFrame:
    """Rows of one task; the comparison reaches the Parquet scan."""
    return df.where(F.col(column) == task)


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
