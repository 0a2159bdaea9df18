"""File listings: what changed between two, and the first row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed or modified) of two listings (path, blob); a path in both with the same blob is none."""
    old, new = before.select("path", F.col("blob").alias("old")), after.select("path", F.col("blob").alias("new"))
    both = old.withColumn("had", F.lit(True)).join(new.withColumn("has", F.lit(True)), "path", "full")
    kind = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").otherwise("modified")
    return both.where("had IS NULL OR has IS NULL OR NOT (old <=> new)").select("path", kind.alias("change"))


def without_tests(files: DataFrame) -> DataFrame:
    """The files that lie in no folder named test."""
    return files.where(~F.col("path").contains("/test/"))


def java_files(files: DataFrame, named: list[str] | None = None) -> DataFrame:
    """The Java files to scan: those named, or all outside of folders named test."""
    java = files.where(F.col("path").endswith(".java"))
    return without_tests(java) if named is None else java.where(F.col("path").isin(named))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is least by the given columns, whatever the partitions; all columns stay. Tasks keep one row a key before anything is shuffled."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("first")).select("first.*")
