"""Column access facts: an append-only log, its state by key, and the reports over that state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["method_id", "table_name", "column_name"]


def column_lineage(log: DataFrame) -> DataFrame:
    """The state that upserts of the log leave: per key the count, first and last time, and the last write's other fields.

    Of writes at the same time the one of the larger event_id is the last.
    """
    last = F.max_by(F.struct("app_id", "method_signature", "operation"), F.struct("ts", "event_id"))
    state = log.groupBy(*KEY).agg(F.count("*").alias("access_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), last.alias("last"))
    return state.select(*KEY, "last.*", "access_count", "first_seen", "last_seen")


def from_relations(relations: DataFrame) -> DataFrame:
    """method_id, table_name, column_name, operation, access_count: one fact for each column of each relation (source, table_name, operation, columns comma-joined).

    Relations of mappers that no method uses (source `mapper:...`) are none; without columns a relation counts for `*`.
    Of repeats of a column in a relation one stays, and relations of one method, table and operation add up.
    """
    names = F.array_distinct(F.filter(F.split(F.coalesce("columns", F.lit("")), ","), lambda c: c != ""))
    named = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("*")))
    rows = relations.where(~F.col("source").startswith("mapper:")).select(F.col("source").alias("method_id"), "table_name", F.explode(named).alias("column_name"), "operation")
    return rows.groupBy("method_id", "table_name", "column_name", "operation").agg(F.count("*").alias("access_count"))


def strongest(operation: Column) -> Column:
    """The aggregate DELETE over INSERT over UPDATE over SELECT."""
    has = lambda op: F.max((operation == op).cast("int")) == 1
    return F.when(has("DELETE"), "DELETE").when(has("INSERT"), "INSERT").when(has("UPDATE"), "UPDATE").otherwise("SELECT")


def field_impact(state: DataFrame, table: str | None = None, column: str | None = None) -> DataFrame:
    """Methods by column that they access, with their strongest operation and their accesses, the most accesses first; all columns by default."""
    if table is not None:
        state = state.where(F.col("table_name") == table)
    if column is not None:
        state = state.where(F.col("column_name") == column)
    return state.groupBy("table_name", "column_name", "method_id", "method_signature", "app_id").agg(strongest(F.col("operation")).alias("operation"), F.sum("access_count").alias("access_count")).orderBy("table_name", "column_name", F.desc("access_count"), "method_id")


def columns_by_table(state: DataFrame) -> DataFrame:
    """Columns of each table, `*` aside, by name."""
    return state.where("column_name <> '*'").select("table_name", "column_name").distinct().orderBy("table_name", "column_name")


def columns_by_method(state: DataFrame) -> DataFrame:
    """Columns of each method, the most accesses first."""
    return state.select("method_id", "table_name", "column_name", "operation", "access_count").orderBy("method_id", F.desc("access_count"), "table_name", "column_name")


def table_stats(state: DataFrame, app: int | str | None = None) -> DataFrame:
    """Columns (`*` counts) and methods by table, and the last access, the most methods first; app None or `%` means all."""
    if app is not None and app != "%":
        state = state.where(F.col("app_id") == app)
    return state.groupBy("table_name").agg(F.countDistinct("column_name").alias("col_count"), F.countDistinct("method_id").alias("method_count"), F.max("last_seen").alias("last_access")).orderBy(F.desc("method_count"), "table_name")


def dead_columns(state: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Columns by table whose last access is more than `days` days before `as_of`, the longest unused first."""
    by = state.groupBy("table_name", "column_name").agg(F.max("last_seen").alias("last_access"), F.sum("access_count").alias("access_count"))
    return by.where(F.col("last_access") < as_of - F.make_interval(days=F.lit(days))).orderBy("last_access", "table_name", "column_name")
