"""Queries over column access facts; the log is derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.fixture import graph, views, with_views
from sparkloom.operators import facts, traverse

AS_OF, DAYS = "2024-01-30 00:00:00", 3


def _state(spark, folder):
    return facts.column_lineage(views(spark, folder, "access_log")[0])


QUERIES = {
    "column_lineage": _state,
    "field_impact": lambda spark, folder: facts.field_impact(_state(spark, folder)),
    "impacted_endpoints": lambda spark, folder: traverse.impacted_endpoints(graph(spark, folder), facts.field_impact(_state(spark, folder))),
    "columns_by_table": lambda spark, folder: facts.columns_by_table(_state(spark, folder)),
    "columns_by_method": lambda spark, folder: facts.columns_by_method(_state(spark, folder)),
    "table_stats": lambda spark, folder: facts.table_stats(_state(spark, folder)),
    "dead_columns": lambda spark, folder: facts.dead_columns(_state(spark, folder), F.lit(AS_OF).cast("timestamp"), DAYS),
}

STATE = """state AS (SELECT method_id, table_name, column_name,
  arg_max(app_id, (ts, event_id)) AS app_id, arg_max(method_signature, (ts, event_id)) AS method_signature, arg_max(operation, (ts, event_id)) AS operation,
  count(*) AS access_count, min(ts) AS first_seen, max(ts) AS last_seen FROM access_log GROUP BY method_id, table_name, column_name)"""


def over_state(sql: str) -> str:
    return with_views("", "access_log").rstrip() + ", " + STATE + " " + sql


ORACLES = {
    "column_lineage": over_state("SELECT * FROM state"),
    "field_impact": over_state("""SELECT table_name, column_name, method_id, method_signature, app_id,
        CASE WHEN bool_or(operation = 'DELETE') THEN 'DELETE' WHEN bool_or(operation = 'INSERT') THEN 'INSERT' WHEN bool_or(operation = 'UPDATE') THEN 'UPDATE' ELSE 'SELECT' END AS operation,
        CAST(sum(access_count) AS BIGINT) AS access_count FROM state GROUP BY ALL"""),
    "columns_by_table": over_state("SELECT DISTINCT table_name, column_name FROM state WHERE column_name <> '*'"),
    "columns_by_method": over_state("SELECT method_id, table_name, column_name, operation, access_count FROM state"),
    "table_stats": over_state("SELECT table_name, count(DISTINCT column_name) AS col_count, count(DISTINCT method_id) AS method_count, max(last_seen) AS last_access FROM state GROUP BY table_name"),
    "dead_columns": over_state(f"SELECT table_name, column_name, max(last_seen) AS last_access, CAST(sum(access_count) AS BIGINT) AS access_count FROM state GROUP BY table_name, column_name HAVING max(last_seen) < TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"),
}

ORACLES["impacted_endpoints"] = with_views("", "methods", "calls", "accesses", "access_log").rstrip() + ", " + STATE + """,
    used AS (SELECT DISTINCT method_id AS seed FROM state),
    walk AS (SELECT seed, seed AS node, 0 AS depth FROM used UNION SELECT w.seed, c.src, w.depth + 1 FROM walk w JOIN calls c ON w.node = c.dst WHERE w.depth < 6),
    up AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node),
    hits AS (SELECT seed, node, depth, row_number() OVER (PARTITION BY seed ORDER BY node) AS n FROM up JOIN methods s ON seed = s.method_id JOIN methods e ON node = e.method_id WHERE depth > 0 AND e.is_entry AND e.app_id = s.app_id),
    impact AS (SELECT table_name, column_name, method_id, sum(access_count) AS access_count FROM state GROUP BY ALL)
    SELECT table_name, column_name, entry, via_method, depth FROM (SELECT table_name, column_name, node AS entry, method_id AS via_method, depth, row_number() OVER (PARTITION BY table_name, column_name, node ORDER BY access_count DESC, method_id) AS nth
      FROM impact JOIN hits ON seed = method_id WHERE n <= 50) x WHERE nth = 1"""
