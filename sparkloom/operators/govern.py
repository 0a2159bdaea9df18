"""Governance metrics by app and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.names import half_up


def duplicate_rate(methods: DataFrame) -> DataFrame:
    """app_id, n_methods, duplication_rate: methods of a repeated signature beyond the first, in percent."""
    by = methods.groupBy("app_id", "signature").agg(F.count("*").alias("n"))
    rows = by.groupBy("app_id").agg(F.sum("n").alias("n_methods"), F.sum(F.col("n") - 1).alias("extra"))
    return rows.select("app_id", "n_methods", half_up(F.col("extra") * 100.0 / F.col("n_methods")).alias("duplication_rate"))


def _coverage() -> Column:
    return half_up(F.col("comment_lines") * 100.0 / F.col("lines"))


def comment_coverage(metrics: DataFrame) -> DataFrame:
    """app_id, lines, comment_lines, comment_coverage (percent) from per-file metrics."""
    rows = metrics.groupBy("app_id").agg(F.sum("lines").alias("lines"), F.sum("comment_lines").alias("comment_lines"))
    return rows.withColumn("comment_coverage", _coverage())


def by_app(metrics: DataFrame, methods: DataFrame) -> DataFrame:
    """app_id, class_count, method_count, complexity, duplication_rate, comment_coverage."""
    # one pass over the metrics, which may be read off every file
    sums = metrics.groupBy("app_id").agg(F.sum("n_classes").alias("class_count"), F.sum("n_methods").alias("method_count"), F.sum("complexity").alias("complexity"), F.sum("lines").alias("lines"), F.sum("comment_lines").alias("comment_lines"))
    rows = sums.join(duplicate_rate(methods).drop("n_methods"), "app_id")
    return rows.select("app_id", "class_count", "method_count", "complexity", "duplication_rate", _coverage().alias("comment_coverage"))


def summary(apps: DataFrame) -> DataFrame:
    """One row: apps, summed counts, and the averages of the rates to one place."""
    return apps.agg(
        F.count("*").alias("apps"), F.sum("class_count").alias("classes"), F.sum("method_count").alias("methods"), F.sum("complexity").alias("complexity"),
        half_up(F.avg("duplication_rate")).alias("avg_duplication"), half_up(F.avg("comment_coverage")).alias("avg_comments"),
    )
