"""Captured SQL and scan progress as streams.

A stream of captures is parsed as it comes; each batch leaves its counts by key in a folder of its own, which a repeated
batch replaces, so that every capture counts once. The facts are the sums over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import sqltext
from sparkloom.scratch import fresh_path

KEY = ["user_id", "table_name", "column_name"]


def parsed(captured: DataFrame) -> DataFrame:
    """A row for each table and column of each capture; `*` where a table has no columns."""
    refs = captured.withColumn("refs", sqltext.column_refs(F.col("sql_text"))).withColumn("operation", sqltext.operation(F.col("sql_text")))
    tables = refs.select("event_id", "ts", "user_id", "operation", "refs", F.explode(sqltext.table_names(F.col("sql_text"))).alias("table_name"))
    columns = sqltext.columns_of(F.col("refs"), F.col("table_name"))
    return tables.select("event_id", "ts", "user_id", "operation", "table_name", F.explode(F.when(F.size(columns) > 0, columns).otherwise(F.array(F.lit("*")))).alias("column_name"))


def counted(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "operation"))
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), last.alias("last"))


def run_once(frame: DataFrame, write, mode: str = "append") -> None:
    """Drive a stream over what there is now; `write` gets each batch and its number."""
    query = frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", fresh_path(frame.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()


def column_access(captured: DataFrame) -> DataFrame:
    """KEY, n, first_seen, last_seen, operation (of the last capture) of a stream (or table) of captures."""
    spark = captured.sparkSession
    if captured.isStreaming:
        out = fresh_path(spark)
        run_once(captured, lambda batch, number: counted(parsed(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}"))
        parts = spark.read.parquet(out)
    else:
        parts = counted(parsed(captured))
    return parts.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last").alias("last")).select(*KEY, "n", "first_seen", F.col("last.ts").alias("last_seen"), F.col("last.operation").alias("operation"))


def seen_tables(captured: DataFrame) -> DataFrame:
    """table_name of all tables of a stream, each once, by stateful deduplication."""
    spark, out = captured.sparkSession, fresh_path(captured.sparkSession)
    tables = captured.select(F.explode(sqltext.table_names(F.col("sql_text"))).alias("table_name")).dropDuplicates(["table_name"])
    run_once(tables, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return spark.read.parquet(out).select("table_name")


#: Stages of a scan in order, with the percentage that each stands for.
STAGES = {"view": ("FETCHING", 10), "click": ("ANALYZING", 30), "signup": ("SQL_PARSING", 70), "purchase": ("COMPLETED", 100), "error": ("FAILED", 100)}


def progress(events: DataFrame) -> DataFrame:
    """user_id, stage, percent, n_events, started, updated: each trace's state after all its events, kept by the stream."""
    spark, out = events.sparkSession, fresh_path(events.sparkSession)
    state = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("n_events"), F.min("ts").alias("started"))
    run_once(state, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), "complete")
    latest = spark.read.parquet(out)
    newest = latest.select(F.max("batch")).first()[0]  # every batch holds all traces; the last one counts
    stage = F.coalesce(*(F.when(F.col("last.event_type") == k, F.lit(s)) for k, (s, _) in STAGES.items()))
    percent = F.coalesce(*(F.when(F.col("last.event_type") == k, F.lit(p)) for k, (_, p) in STAGES.items()))
    return latest.where(F.col("batch") == newest).select("user_id", stage.alias("stage"), percent.alias("percent"), "n_events", "started", F.col("last.ts").alias("updated"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
