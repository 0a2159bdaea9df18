"""Scans as chains of events: the log of a trace, its state, timings and counters.

Events are rows of trace, event_id, ts, stage, with counters where they have any. A trace ends with its first terminal
event; what comes later does not count. All reports are aggregates by trace and joins with one row a trace, so that a
trace of very many events is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stages of a scan in order, and the percentage that stands for a stage whose number of files is unknown.
STAGES = {"PENDING": 0, "FETCHING": 5, "ANALYZING": 50, "SQL_PARSING": 80, "WRITING_GRAPH": 95, "COMPLETED": 100, "FAILED": 100}
TERMINAL = ["COMPLETED", "FAILED"]
#: The event that says a stage is reached.
EVENTS = {"FETCHING": "ScanRequested", "ANALYZING": "CodeFetched", "SQL_PARSING": "CodeAnalyzed", "WRITING_GRAPH": "SqlParsed", "COMPLETED": "ScanCompleted", "FAILED": "ProcessFailed"}


def event_of(stage: Column) -> Column:
    return F.coalesce(*(F.when(stage == s, e) for s, e in EVENTS.items()))


def log_of(events: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """The events that count, of all traces or those given (trace), with the name of each."""
    if traces is not None:
        events = events.join(traces.select("trace").distinct(), "trace", "left_semi")
    ends = events.where(F.col("stage").isin(TERMINAL)).groupBy("trace").agg(F.min(F.struct("ts", "event_id")).alias("end"))
    rows = events.join(ends, "trace", "left").where("end IS NULL OR struct(ts, event_id) <= end").drop("end")
    return rows.withColumn("event", event_of(F.col("stage")))


def percent(stage: Column, done: Column, total: Column) -> Column:
    """100 for ended scans; the stage's own where the number of files is 0; else the share done, 99 at most."""
    own = F.coalesce(*(F.when(stage == s, p) for s, p in STAGES.items()), F.lit(0))
    return F.when(stage.isin(TERMINAL), 100).when(total == 0, own).otherwise(F.least(F.lit(99), F.floor(done * 100 / total))).cast("int")


def states(events: DataFrame) -> DataFrame:
    """trace, stage, percent, files_done, files, n_events, started, updated, finished, elapsed_ms, timings.

    events have files_done and files, of which the largest count. timings: by stage, in order, the milliseconds from its
    last event to the next event of the trace; elapsed_ms goes to the end of an ended scan, else to its last event.
    """
    rows = log_of(events)
    at = F.struct("ts", "event_id")
    last = {s: F.max(F.when(F.col("stage") == s, at)).alias(f"last_{s}") for s in EVENTS}
    one = rows.groupBy("trace").agg(F.max_by("stage", at).alias("stage"), F.max("files_done").alias("files_done"), F.max("files").alias("files"), F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("updated"), *last.values())
    timed = [s for s in EVENTS if s not in TERMINAL]
    after = rows.select("trace", at.alias("at")).join(one.select("trace", *(f"last_{s}" for s in timed)), "trace")
    nexts = after.groupBy("trace").agg(*(F.min(F.when(F.col("at") > F.col(f"last_{s}"), F.col("at.ts"))).alias(f"next_{s}") for s in timed))
    millis = lambda a, b: F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1000).cast("long")
    spans = F.array_compact(F.array(*(F.when(F.col(f"next_{s}").isNotNull(), F.struct(F.lit(s).alias("stage"), millis(F.col(f"last_{s}.ts"), F.col(f"next_{s}")).alias("millis"))) for s in timed)))
    ended = F.col("stage").isin(TERMINAL)
    return one.join(nexts, "trace").select(
        "trace", "stage", percent(F.col("stage"), F.col("files_done"), F.col("files")).alias("percent"), "files_done", "files", "n_events", "started", "updated",
        F.when(ended, F.col("updated")).alias("finished"), millis(F.col("started"), F.col("updated")).alias("elapsed_ms"), spans.alias("timings"),
    )


def active(found: DataFrame) -> DataFrame:
    """The scans that go on, the oldest first."""
    return found.where("finished IS NULL").orderBy("started", "trace")


def ended(found: DataFrame) -> DataFrame:
    """The scans that have ended, the newest first."""
    return found.where("finished IS NOT NULL").orderBy(F.desc("started"), "trace")
