"""A deterministic method/table graph over the driver's tables.

Methods are parts, calls and accesses are line items, the access log is the events table.
Only integer arithmetic is used, so any SQL engine derives the same rows from the same files.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.tables import table

#: View definitions shared by Spark and the SQL oracles; `n_methods` is the number of parts.
VIEWS = {
    "methods": """
        SELECT CAST(p_partkey AS BIGINT) AS method_id, CAST(p_partkey % 5 AS INT) AS app_id, p_size <= 10 AS is_entry,
               concat(p_type, CASE WHEN p_partkey % 3 = 0 THEN 'Controller' ELSE 'Service' END) AS class_name,
               concat('m', CAST(p_partkey AS VARCHAR(20)), '()') AS signature
        FROM part""",
    "calls": """
        SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS call_id,
               CAST(l_partkey AS BIGINT) AS src,
               CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 31) % (SELECT count(*) FROM part) AS BIGINT) AS dst,
               CASE WHEN l_returnflag = 'R' THEN 'EXTERNAL' ELSE 'INTERNAL' END AS call_type,
               CAST(l_linenumber AS INT) AS line_number
        FROM lineitem WHERE l_quantity >= 49""",
    "accesses": """
        SELECT CAST(l_partkey AS BIGINT) AS method_id, CAST(l_suppkey % 25 AS INT) AS table_id,
               CASE WHEN l_returnflag = 'A' THEN 'INSERT' WHEN l_returnflag = 'R' THEN 'DELETE'
                    WHEN l_linestatus = 'O' THEN 'UPDATE' ELSE 'SELECT' END AS operation
        FROM lineitem WHERE l_quantity <= 4""",
    "access_log": """
        SELECT event_id, ts, event_type, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
               CAST(user_id % 5 AS INT) AS app_id, user_id AS method_id,
               concat('m', CAST(user_id AS VARCHAR(20)), '()') AS method_signature,
               concat('t', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS VARCHAR(20))) AS table_name,
               CASE WHEN event_id % 17 = 0 THEN '*' ELSE concat('c', regexp_extract(props, '([0-9]+)', 1)) END AS column_name,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'SELECT' END AS operation
        FROM events""",
    "captured_sql": """
        SELECT event_id, ts, user_id, k,
               CASE event_type
                 WHEN 'view' THEN concat('SELECT ', table_name, '.c', k, ', u.name FROM ', table_name, ' JOIN users u ON u.id = ', table_name, '.uid WHERE u.id = ', user_id)
                 WHEN 'click' THEN concat('WITH recent AS (SELECT id FROM "log', k, '") SELECT r.c', k, ' FROM recent r JOIN "', table_name, '" ON r.id = 1.5')
                 WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN concat('INSERT INTO `', table_name, '` (c', k, ', name) VALUES (1, 2) ON DUPLICATE KEY UPDATE c', k, ' = 2')
                                    ELSE concat('insert into ', table_name, ' (`c', k, '`, "name") values (1, 2)') END
                 WHEN 'purchase' THEN concat('UPDATE public.', table_name, ' SET c', k, ' = 1, "price" = 2 WHERE id = ', user_id, ' RETURNING id, c', k)
                 ELSE CASE WHEN k % 3 = 0 THEN concat('REPLACE INTO `shop`.`', table_name, '` VALUES (', k, ')') ELSE concat('DELETE FROM `', table_name, '` WHERE c', k, ' = 1') END
               END AS sql_text,
               CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'jdbc:mysql://db/x' WHEN 1 THEN 'jdbc:PostgreSQL://db/x' WHEN 2 THEN 'jdbc:db2://db/x'
                    WHEN 3 THEN 'jdbc:oracle:thin:@db' WHEN 4 THEN 'jdbc:sqlserver://db' ELSE 'jdbc:h2:mem' END AS jdbc_url
        FROM access_log""",
    "call_texts": """
        SELECT call_id, src, dst, call_type,
               CASE CAST(dst % 4 AS INT)
                 WHEN 0 THEN concat('restTemplate.postForObject("http://app-', dst % 5, '/api/m', dst, '", req)')
                 WHEN 1 THEN concat('webClient.get(https://app-', dst % 5, '/api/m', dst, ',x)')
                 WHEN 2 THEN concat('dubboService.', CASE WHEN dst % 3 = 0 THEN 'PROMOCont' WHEN dst % 3 = 1 THEN 'RGEServ' ELSE concat('m', dst) END, '(param)')
                 ELSE concat('helper.m', dst, '()') END AS expression
        FROM calls""",
}


@dataclass(frozen=True)
class Graph:
    """A method/table graph as three DataFrames."""

    methods: DataFrame
    calls: DataFrame
    accesses: DataFrame


class Scope:
    """Named frames of one query, as temporary views that no other query sees."""

    def __init__(self, spark: SparkSession):
        self.spark, self.prefix, self.names = spark, f"loom_{uuid.uuid4().hex[:12]}_", set()

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        frame.createOrReplaceTempView(self.prefix + name)
        self.names.add(name)
        return frame

    def sql(self, query: str) -> DataFrame:
        """The query with the names of this scope after FROM and JOIN."""
        return self.spark.sql(re.sub(r"\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: m[1] + m[2] + (self.prefix if m[3] in self.names else "") + m[3], query))


def tables(spark: SparkSession, folder: str, *names: str) -> Scope:
    """A scope of the named input tables."""
    scope = Scope(spark)
    for name in names:
        scope.put(name, table(spark, folder, name))
    return scope


def graph(spark: SparkSession, folder: str) -> Graph:
    """The fixture's graph; each frame is lazy."""
    scope = tables(spark, folder, "part", "lineitem")
    return Graph(*(scope.sql(VIEWS[name]) for name in ("methods", "calls", "accesses")))


def whole_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph with a call and an access of every line item; repeats of a call's id are numbered, so that ids stay unique."""
    scope = tables(spark, folder, "part", "lineitem")
    every = {name: VIEWS[name].rsplit(" WHERE l_quantity", 1)[0] for name in ("calls", "accesses")}
    calls = scope.sql(every["calls"])
    nth = F.row_number().over(Window.partitionBy("call_id").orderBy("src", "dst", "call_type", "line_number"))
    calls = calls.withColumn("nth", nth).withColumn("call_id", F.concat("call_id", F.lit("-"), F.col("nth").cast("string"))).drop("nth")
    return Graph(scope.sql(VIEWS["methods"]), calls, scope.sql(every["accesses"]))


def views(spark: SparkSession, folder: str, *names: str, **given: DataFrame) -> list[DataFrame]:
    """The named views as lazy frames; they may refer to tables, to views named before, and to frames given by name, which stand for tables."""
    scope = tables(spark, folder, "part", "lineitem", "events", "supplier")
    for name, frame in given.items():
        scope.put(name, frame)
    return [scope.put(name, scope.sql(VIEWS[name])) for name in names]


def whole_definitions() -> dict[str, str]:
    """The definitions of calls and accesses over every line item, as whole_graph() has them."""
    every = {name: VIEWS[name].rsplit(" WHERE l_quantity", 1)[0] for name in ("calls", "accesses")}
    return {
        "calls": f"""
        SELECT concat(call_id, '-', CAST(row_number() OVER (PARTITION BY call_id ORDER BY src, dst, call_type, line_number) AS VARCHAR(20))) AS call_id, src, dst, call_type, line_number FROM ({every["calls"]}) every""",
        "accesses": every["accesses"],
    }


def whole_views(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """views() whose calls and accesses take every line item."""
    scope, definitions = tables(spark, folder, "part", "lineitem", "events", "supplier"), VIEWS | whole_definitions()
    return [scope.put(name, scope.sql(definitions[name])) for name in names]


def with_views(sql: str, *names: str) -> str:
    """`sql` after the named view definitions, as one statement."""
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({VIEWS[name]})" for name in names) + " " + sql


def with_whole_views(sql: str) -> str:
    """A statement of with_views() over the calls and accesses of every line item, as whole_graph() has them."""
    whole = whole_definitions()
    return sql.replace(VIEWS["calls"], whole["calls"]).replace(VIEWS["accesses"], whole["accesses"])
