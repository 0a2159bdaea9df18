"""Queries over listings, first writes and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.fixture import views, with_views
from sparkloom.operators import facts, scans
from sparkloom.plans.fact_queries import over_state
from sparkloom.sources import listings
from sparkloom.tables import table


def _listing(lines):
    """Orders as files, their lines as content."""
    body = F.concat_ws("-", F.count("*").cast("string"), F.sum(F.col("l_quantity").cast("long")).cast("string"))
    return lines.groupBy(F.col("l_orderkey").alias("path")).agg(F.md5(body.cast("binary")).alias("blob"))


def _listing_diff(spark, folder):
    lines = table(spark, folder, "lineitem")
    return listings.changed(_listing(lines.where("l_linenumber < 5 AND l_orderkey % 10 <> 3")), _listing(lines.where("l_orderkey % 10 <> 7")))


def _first_access(spark, folder):
    """The first access of each method to each table, by time, then event."""
    log = views(spark, folder, "access_log")[0]
    return listings.first_wins(log.select("method_id", "table_name", "operation", "ts", "event_id"), ["method_id", "table_name"], ["ts", "event_id"])


STAGE_OF = {"view": "FETCHING", "click": "ANALYZING", "signup": "SQL_PARSING", "purchase": "COMPLETED", "error": "FAILED"}


def scan_events(spark, folder):
    """A scan for each user and day: its events are stages, k the files done of 80, where a scan knows their number."""
    log = views(spark, folder, "access_log")[0]
    stage = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STAGE_OF.items()))
    trace = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return log.select(trace.alias("trace"), "event_id", "ts", stage.alias("stage"), F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("k")).alias("files_done"), F.when(F.col("user_id") % 3 == 0, 0).otherwise(80).alias("files"))


def _scan_states(spark, folder):
    found = scans.states(scan_events(spark, folder))
    timings = F.array_join(F.transform("timings", lambda t: F.concat_ws("=", t["stage"], t["millis"].cast("string"))), ";")
    return found.withColumn("timings", timings).drop("started", "updated", "finished")


def _scan_log(spark, folder):
    """The events that count of the scans of every tenth user."""
    events = scan_events(spark, folder)
    return scans.log_of(events, events.where("CAST(split(trace, '/')[0] AS INT) % 10 = 0")).select("trace", "event_id", "event")


def _scan_history(spark, folder):
    return scans.ended(scans.states(scan_events(spark, folder))).select("trace", "stage", "started", "finished")


def _active_scans(spark, folder):
    return scans.active(scans.states(scan_events(spark, folder))).select("trace", "stage", "percent", "started")


def _totals(spark, folder):
    stats = facts.table_stats(facts.column_lineage(views(spark, folder, "access_log")[0]))
    return stats.agg(F.sum("col_count").alias("columns"), F.sum("method_count").alias("methods"), F.count("*").alias("tables"))


QUERIES = {"listing_diff": _listing_diff, "first_access": _first_access, "scan_states": _scan_states, "scan_log": _scan_log, "ended_scans": _scan_history, "active_scans": _active_scans, "fact_totals": _totals}

def scan_sql(sql):
    """`sql` over the events that count, the state by trace and its timings."""
    return with_views("", "access_log").rstrip() + """, scans AS (SELECT concat(user_id, '/', strftime(ts, '%Y-%m-%d')) AS trace, event_id, ts, CASE event_type WHEN 'view' THEN 'FETCHING' WHEN 'click' THEN 'ANALYZING' WHEN 'signup' THEN 'SQL_PARSING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS stage,
          CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE k END AS INTEGER) AS files_done, CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 80 END AS INTEGER) AS files FROM access_log),
        counted AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN stage IN ('COMPLETED', 'FAILED') THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM scans) x WHERE over_ = 0),
        state AS (SELECT trace, arg_max(stage, (ts, event_id)) AS stage, max(files_done) AS files_done, max(files) AS files, count(*) AS n_events, min(ts) AS started, max(ts) AS updated FROM counted GROUP BY trace),
        times AS (SELECT trace, string_agg(concat(stage, '=', (epoch_us(next) - epoch_us(ts)) // 1000), ';' ORDER BY CASE stage WHEN 'FETCHING' THEN 1 WHEN 'ANALYZING' THEN 2 ELSE 3 END) AS timings FROM (
          SELECT trace, stage, ts, next, row_number() OVER (PARTITION BY trace, stage ORDER BY ts DESC, event_id DESC) AS nth FROM (SELECT *, lead(ts) OVER (PARTITION BY trace ORDER BY ts, event_id) AS next FROM counted) y) z
          WHERE nth = 1 AND next IS NOT NULL AND stage NOT IN ('COMPLETED', 'FAILED') GROUP BY trace) """ + sql


ORACLES = {
    "listing_diff": """WITH a AS (SELECT l_orderkey AS path, md5(concat(count(*), '-', sum(CAST(trunc(l_quantity) AS BIGINT)))) AS blob FROM lineitem WHERE l_linenumber < 5 AND l_orderkey % 10 <> 3 GROUP BY l_orderkey),
        b AS (SELECT l_orderkey AS path, md5(concat(count(*), '-', sum(CAST(trunc(l_quantity) AS BIGINT)))) AS blob FROM lineitem WHERE l_orderkey % 10 <> 7 GROUP BY l_orderkey)
        SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.blob IS DISTINCT FROM b.blob""",
    "first_access": with_views("SELECT method_id, table_name, operation, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY method_id, table_name ORDER BY ts, event_id) AS nth FROM access_log) x WHERE nth = 1", "access_log"),
    "scan_states": scan_sql("""SELECT trace, stage, CAST(CASE WHEN stage IN ('COMPLETED', 'FAILED') THEN 100 WHEN files = 0 THEN CASE stage WHEN 'FETCHING' THEN 5 WHEN 'ANALYZING' THEN 50 ELSE 80 END ELSE least(99, files_done * 100 // files) END AS INTEGER) AS percent,
        files_done, files, n_events, (epoch_us(updated) - epoch_us(started)) // 1000 AS elapsed_ms, coalesce(timings, '') AS timings FROM state LEFT JOIN times USING (trace)"""),
    "scan_log": scan_sql("SELECT trace, event_id, CASE stage WHEN 'FETCHING' THEN 'ScanRequested' WHEN 'ANALYZING' THEN 'CodeFetched' WHEN 'SQL_PARSING' THEN 'CodeAnalyzed' WHEN 'COMPLETED' THEN 'ScanCompleted' ELSE 'ProcessFailed' END AS event FROM counted WHERE CAST(split_part(trace, '/', 1) AS INTEGER) % 10 = 0"),
    "ended_scans": scan_sql("SELECT trace, stage, started, updated AS finished FROM state WHERE stage IN ('COMPLETED', 'FAILED')"),
    "active_scans": scan_sql("SELECT trace, stage, CAST(CASE WHEN files = 0 THEN CASE stage WHEN 'FETCHING' THEN 5 WHEN 'ANALYZING' THEN 50 ELSE 80 END ELSE least(99, files_done * 100 // files) END AS INTEGER) AS percent, started FROM state WHERE stage NOT IN ('COMPLETED', 'FAILED')"),
    "fact_totals": over_state("SELECT CAST(sum(c) AS BIGINT) AS columns, CAST(sum(m) AS BIGINT) AS methods, count(*) AS tables FROM (SELECT table_name, count(DISTINCT column_name) AS c, count(DISTINCT method_id) AS m FROM state GROUP BY table_name) x"),
}
