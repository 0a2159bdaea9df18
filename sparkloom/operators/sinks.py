"""Writes that may be repeated without harm, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` with `rows` in place of its rows of the same keys; of several rows of a key the largest wins. No rows, no change."""
    kept = existing.join(rows.select(keys).distinct(), keys, "left_anti").select(existing.columns)
    others = [c for c in existing.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("last")).select(*keys, "last.*")
    return kept.unionByName(last.select(existing.columns))


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """Add the rows of one run to the table at `path`; a run that is written again replaces itself."""
    append_runs(rows.withColumn("run", F.lit(run)), path)


def append_runs(rows: DataFrame, path: str, by: str = "run") -> None:
    """Add rows to the table at `path`, which lies in a folder for each value of `by`; the values that the rows have are replaced, others stay."""
    rows.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all runs, with the run's name."""
    return spark.read.option("recursiveFileLookup", "false").parquet(path)


def newest(rows: DataFrame, most: int, created: str = "created", ties: tuple[str, ...] = (), **equal: object) -> DataFrame:
    """The `most` newest rows whose columns equal the given values (None: any), newest first; ties by the given columns."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(created), *ties).limit(most)


def newest_of_each(rows: DataFrame, keys: list[str], most: int, order: list[Column]) -> DataFrame:
    """The first `most` rows of each key in the given order."""
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("nth") <= most).drop("nth")


def apps_to_scan(apps: DataFrame, methods: DataFrame) -> DataFrame:
    """The apps (app_id) that have no entry method yet: a scan that was done is not repeated."""
    return apps.join(methods.where("is_entry").select("app_id").distinct(), "app_id", "left_anti")
