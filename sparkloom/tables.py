"""Reading the input tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, one Parquet file or directory."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
