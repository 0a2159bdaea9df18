"""Queries that run as streams to their end, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.fixture import views, with_views
from sparkloom.operators import facts, report, scans
from sparkloom.plans.fact_queries import AS_OF, DAYS, over_state
from sparkloom.plans.text_queries import ORACLES as TEXTS
from sparkloom.plans.listing_queries import scan_events, scan_sql
from sparkloom.scratch import fresh_path
from sparkloom.sources import messages
from sparkloom.streaming import capture, traces

PARTS = 4


def _captured_stream(spark, folder):
    """The events as a stream of captured SQL."""
    return views(spark, folder, "access_log", "captured_sql", events=capture.event_stream(spark, folder))[1]


def _prompts(spark, folder):
    state = facts.column_lineage(views(spark, folder, "access_log")[0])
    return report.table_prompts(state, F.lit(AS_OF).cast("timestamp"), DAYS)


def _scan_history(spark, folder):
    """The latest event of each user, as a scan's last status."""
    return report.latest(views(spark, folder, "access_log")[0].select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


def _timed(spark, folder):
    """The events of scans with times that a watermark can follow."""
    return scan_events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(rows, *times):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _trace_states(spark, folder):
    """The state of each scan, kept by a stream that gets the events in files; each batch puts out the scans that it changes."""
    events = traces.in_files(_timed(spark, folder), PARTS)
    found = traces.kept(traces.states(events), ["trace"])
    order = [s for s in scans.EVENTS if s not in scans.TERMINAL]
    said = F.array_join(F.array_compact(F.array(*(F.when(F.col("timings")[s].isNotNull(), F.concat_ws("=", F.lit(s), F.col("timings")[s].cast("string"))) for s in order))), ";")
    found = _plain(found, "started", "updated", "finished")
    return found.select("trace", "stage", scans.percent(F.col("stage"), F.col("files_done"), F.col("files")).alias("percent"), "files_done", "files", "n_events", "started", "updated", "finished", said.alias("timings"))


def _scan_chains(spark, folder):
    events = traces.with_end(_timed(spark, folder))
    return _plain(traces.drained(traces.chains(traces.in_files(events, PARTS))), "requested_at")


def _published(spark, folder):
    """The events that count, published by class; a second time under the same name, which adds nothing."""
    events = scans.log_of(scan_events(spark, folder)).select("trace", "event_id", "stage", "files_done", "event")
    root = fresh_path(spark)
    for _ in range(2):
        messages.publish(report.event_messages(events), root, "scan")
    return messages.published(spark, root)


def _published_stream(spark, folder):
    """All events as a stream brings them, published by class, batch by batch."""
    events = traces.in_files(_timed(spark, folder), PARTS).withColumn("event", scans.event_of(F.col("stage"))).drop("ts", "files")
    root = fresh_path(spark)
    messages.publish(report.event_messages(events), root, "scan")
    return messages.published(spark, root).groupBy("topic", "key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.get_json_object("value", "$.event_id").cast("long"))), ",").alias("events"))


def _event_json(spark, folder):
    log = views(spark, folder, "access_log")[0]
    return report.as_messages(log.select("event_id", "user_id", "table_name", "operation"), "user_id", "event_id").select("topic", "key", "value")


def _documents(spark, folder):
    """What is known of each table, as an indented JSON document."""
    stats = facts.table_stats(facts.column_lineage(views(spark, folder, "access_log")[0])).drop("last_access")
    return report.as_document(stats, "table_name")


QUERIES = {
    "capture_stream": lambda spark, folder: capture.column_access(_captured_stream(spark, folder)),
    "capture_tables": lambda spark, folder: capture.seen_tables(_captured_stream(spark, folder)),
    "progress_state": lambda spark, folder: capture.progress(capture.event_stream(spark, folder)),
    "trace_state_stream": _trace_states,
    "scan_chains": _scan_chains,
    "published_events": _published,
    "published_stream": _published_stream,
    "scan_history": _scan_history,
    "event_messages": _event_json,
    "report_prompts": _prompts,
    "table_documents": _documents,
}

_PARSED = TEXTS["sql_parsed"]
ORACLES = {
    "capture_stream": f"""WITH p AS ({_PARSED}), e AS (SELECT event_id, ts, user_id FROM events),
        x AS (SELECT p.event_id, e.ts, e.user_id, p.operation, p.table_name, unnest(CASE WHEN columns = '' THEN ['*'] ELSE string_split(columns, ',') END) AS column_name FROM p JOIN e ON p.event_id = e.event_id)
        SELECT user_id, table_name, column_name, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(operation, (ts, event_id)) AS operation FROM x GROUP BY user_id, table_name, column_name""",
    "capture_tables": f"SELECT DISTINCT table_name FROM ({_PARSED}) p",
    "progress_state": """SELECT user_id, CASE last WHEN 'view' THEN 'FETCHING' WHEN 'click' THEN 'ANALYZING' WHEN 'signup' THEN 'SQL_PARSING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS stage,
        CASE last WHEN 'view' THEN 10 WHEN 'click' THEN 30 WHEN 'signup' THEN 70 ELSE 100 END AS percent, n_events, started, updated
        FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) AS n_events, min(ts) AS started, max(ts) AS updated FROM events GROUP BY user_id) x""",
    "scan_history": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) x WHERE nth = 1",
    "event_messages": with_views("""SELECT 'lineage.access' AS topic, CAST(user_id AS VARCHAR) AS key, concat('{"event_id":', event_id, ',"user_id":', user_id, ',"table_name":"', table_name, '","operation":"', operation, '"}') AS value FROM access_log""", "access_log"),
    "table_documents": over_state("""SELECT table_name, concat('{', chr(10), '  "table_name" : "', table_name, '",', chr(10), '  "col_count" : ', count(DISTINCT column_name), ',', chr(10), '  "method_count" : ', count(DISTINCT method_id), chr(10), '}') AS document FROM state GROUP BY table_name"""),
    "report_prompts": over_state(f"""SELECT k.table_name, concat('## Table ', k.table_name, chr(10), 'Columns in use (', n_columns, '): ', columns, chr(10), 'Methods that access it: ', n_methods, '; strongest operation: ', operation, chr(10),
        'Columns without recent access: ', coalesce(dead, 'none'), chr(10), 'Say what a change of this table would touch, and what could be removed.') AS prompt
        FROM (SELECT table_name, count(DISTINCT column_name) AS n_columns, string_agg(DISTINCT column_name, ', ' ORDER BY column_name) AS columns, count(DISTINCT method_id) AS n_methods,
          CASE WHEN bool_or(operation = 'DELETE') THEN 'DELETE' WHEN bool_or(operation = 'INSERT') THEN 'INSERT' WHEN bool_or(operation = 'UPDATE') THEN 'UPDATE' ELSE 'SELECT' END AS operation
          FROM state WHERE column_name <> '*' GROUP BY table_name) k
        LEFT JOIN (SELECT table_name, string_agg(column_name, ', ' ORDER BY column_name) AS dead FROM (SELECT table_name, column_name FROM state GROUP BY table_name, column_name
          HAVING max(last_seen) < TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY) x GROUP BY table_name) d ON k.table_name = d.table_name"""),
}

_STEP = "{b}.trace = {a}.trace AND {b}.ts > {a}.ts AND {b}.ts <= {a}.ts + INTERVAL 12 HOUR"
ORACLES |= {
    "trace_state_stream": scan_sql("""SELECT trace, stage, CAST(CASE WHEN stage IN ('COMPLETED', 'FAILED') THEN 100 WHEN files = 0 THEN CASE stage WHEN 'FETCHING' THEN 5 WHEN 'ANALYZING' THEN 50 ELSE 80 END ELSE least(99, files_done * 100 // files) END AS INTEGER) AS percent,
        files_done, files, n_events, started, updated, CASE WHEN stage IN ('COMPLETED', 'FAILED') THEN updated END AS finished, coalesce(timings, '') AS timings FROM state LEFT JOIN times USING (trace)"""),
    "scan_chains": scan_sql(f"""SELECT r.trace, r.event_id AS requested, f.event_id AS fetched, a.event_id AS analyzed, e.event_id AS ended, r.ts AS requested_at, coalesce(e.stage, 'FAILED') AS outcome
        FROM scans r JOIN scans f ON f.stage = 'ANALYZING' AND {_STEP.format(a="r", b="f")} JOIN scans a ON a.stage = 'SQL_PARSING' AND {_STEP.format(a="f", b="a")}
        LEFT JOIN scans e ON e.stage IN ('COMPLETED', 'FAILED') AND {_STEP.format(a="a", b="e")} WHERE r.stage = 'FETCHING'"""),
}
_TOPIC = "concat('lineage.', CASE stage WHEN 'FETCHING' THEN 'ScanRequested' WHEN 'ANALYZING' THEN 'CodeFetched' WHEN 'SQL_PARSING' THEN 'CodeAnalyzed' WHEN 'COMPLETED' THEN 'ScanCompleted' ELSE 'ProcessFailed' END)"
ORACLES |= {
    "published_events": scan_sql(f"""SELECT {_TOPIC} AS topic, trace AS key, concat('{{"trace":"', trace, '","event_id":', event_id, ',"stage":"', stage, '","files_done":', files_done, '}}') AS value FROM counted"""),
    "published_stream": scan_sql(f"SELECT {_TOPIC} AS topic, trace AS key, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS events FROM scans GROUP BY ALL"),
}
