"""Queries over captured SQL texts and call expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.fixture import views, with_views
from sparkloom.functions import names, sqltext


def _captured(columns):
    """A query of event_id and the columns that `columns` makes of the SQL text and the JDBC URL."""

    def query(spark, folder):
        captured = views(spark, folder, "access_log", "captured_sql")[1]
        made = columns(F.col("sql_text"), F.col("jdbc_url"))
        return captured.select("event_id", *(c.alias(n) for n, c in made.items()))

    return query


def _joined(array):
    """A set as one comparable string."""
    return F.array_join(F.array_sort(array), ",")


def _call_texts(spark, folder):
    return views(spark, folder, "calls", "call_texts")[1]


def _refs(r):
    return F.concat_ws(":", F.coalesce(r["table"], F.lit("")), r["column"], r["source"])


def _parsed(spark, folder):
    """One row per statement and table, with the columns that belong to it."""
    captured = views(spark, folder, "access_log", "captured_sql")[1]
    sql = F.col("sql_text")
    tables = captured.withColumn("refs", sqltext.column_refs(sql)).withColumn("operation", sqltext.operation(sql)).withColumn("table", F.explode(sqltext.table_names(sql)))
    return tables.select("event_id", F.col("table").alias("table_name"), "operation", _joined(sqltext.columns_of(F.col("refs"), F.col("table"))).alias("columns"))


def _dialect(sql, url):
    kind = sqltext.db_type(url)
    return {"db_type": kind, "tables": _joined(sqltext.dialect_tables(kind, sql)), "sql_500": F.substring(sql, 1, 500)}


#: How the names of methods begin, by method_id, and the operation that each stands for.
BEGINNINGS = {"": "SELECT", "remove_": "DELETE", "Update": "UPDATE", "saveAll": "INSERT", "find": "SELECT", "create": "INSERT", "modify": "UPDATE", "delete": "DELETE", "add": "INSERT"}


def _name_parts(spark, folder):
    methods = views(spark, folder, "methods")[0]
    begin = F.element_at(F.array(*map(F.lit, BEGINNINGS)), (F.col("method_id") % len(BEGINNINGS) + 1).cast("int"))
    full = F.concat(F.lit("app-"), F.col("app_id"), F.lit(":shop."), F.translate("class_name", " ", "_"), F.lit("."), begin, F.col("signature"))
    name = names.method_name(F.col("id"))
    return methods.withColumn("id", full).select("method_id", names.app_of(F.col("id")).alias("app"), name.alias("name"), names.class_of(F.col("id")).alias("class"), names.signature_of(F.col("id")).alias("sig"), sqltext.operation_of_name(name).alias("operation"))


#: Names that databases give themselves, by user_id.
PRODUCTS = {"MySQL": "MYSQL", "PostgreSQL": "POSTGRESQL", "DB2/LINUXX8664": "DB2", "Oracle": "ORACLE", "Microsoft SQL Server": "SQLSERVER", "H2": "GENERIC", "mysql community": "MYSQL"}


def _products(spark, folder):
    """The type of database of each capture by the name of its product."""
    captured = views(spark, folder, "access_log", "captured_sql")[1]
    product = F.element_at(F.array(*map(F.lit, PRODUCTS)), (F.col("user_id") % len(PRODUCTS) + 1).cast("int"))
    return captured.select("event_id", product.alias("product"), sqltext.db_type_of_product(product).alias("db_type"))


QUERIES = {
    "sql_products": _products,
    "sql_tables": _captured(lambda sql, url: {"tables": _joined(sqltext.table_names(sql))}),
    "sql_operation": _captured(lambda sql, url: {"operation": sqltext.operation(sql)}),
    "sql_columns": _captured(lambda sql, url: {"columns": _joined(F.transform(sqltext.column_refs(sql), _refs))}),
    "sql_parsed": _parsed,
    "sql_dialect_mysql": _captured(lambda sql, url: {"tables": _joined(sqltext.mysql_tables(sql)), "schemas": _joined(F.map_values(sqltext.mysql_schemas(sql)))}),
    "sql_dialect_pg": _captured(lambda sql, url: {"tables": _joined(sqltext.pg_tables(sql)), "returning": _joined(sqltext.returning_columns(sql))}),
    "sql_by_dialect": _captured(_dialect),
    "url_path": lambda spark, folder: _call_texts(spark, folder).select("call_id", names.url_path(F.col("expression")).alias("path")),
    "rpc_method": lambda spark, folder: _call_texts(spark, folder).select("call_id", names.rpc_method(F.col("expression")).alias("method")),
    "name_parts": _name_parts,
}

_TABLES = f"""list_filter(list_distinct(list_transform(regexp_extract_all(trim(sql_text), '{sqltext.TABLES}', 1), lambda t: replace(replace(t, '`', ''), '"', ''))), lambda t: upper(t) <> 'DUAL')"""
_MYSQL = """list_distinct(list_concat({}, regexp_extract_all(sql_text, '{}', 1)))""".format(_TABLES, sqltext.BACKTICK_TABLES)
_PG = """list_filter(list_distinct(list_concat({}, regexp_extract_all(sql_text, '{}', 1))), lambda t: upper(t) <> 'DUAL' AND NOT list_contains(list_transform(regexp_extract_all(sql_text, '{}', 1), lambda c: lower(c)), t))""".format(_TABLES, sqltext.PG_TABLES, sqltext.CTE_NAMES)
_SORTED = "array_to_string(list_sort({}), ',')"
_OPERATION = """CASE WHEN regexp_matches(trim(sql_text), '(?i)^(INSERT|REPLACE|UPSERT)') THEN 'INSERT' WHEN regexp_matches(trim(sql_text), '(?i)^(UPDATE|MERGE)') THEN 'UPDATE'
  WHEN regexp_matches(trim(sql_text), '(?i)^(DELETE|TRUNCATE)') THEN 'DELETE' ELSE 'SELECT' END"""
_DB_TYPE = """CASE WHEN lower(jdbc_url) LIKE '%mysql%' THEN 'MYSQL' WHEN lower(jdbc_url) LIKE '%postgresql%' OR lower(jdbc_url) LIKE '%pgsql%' THEN 'POSTGRESQL'
  WHEN lower(jdbc_url) LIKE '%db2%' THEN 'DB2' WHEN lower(jdbc_url) LIKE '%oracle%' THEN 'ORACLE' WHEN lower(jdbc_url) LIKE '%sqlserver%' THEN 'SQLSERVER' ELSE 'GENERIC' END"""
_KEYWORDS = ", ".join(f"'{k}'" for k in sqltext.KEYWORDS)
_REFS = f"""refs AS (
  SELECT event_id, 1 AS src, unnest(regexp_extract_all(sql_text, '{sqltext.QUALIFIED}', 1)) AS t, unnest(regexp_extract_all(sql_text, '{sqltext.QUALIFIED}', 2)) AS c FROM captured_sql
  UNION ALL SELECT event_id, src, NULL, unnest(string_split(list, ',')) FROM (
    SELECT event_id, 2 AS src, unnest(regexp_extract_all(sql_text, '{sqltext.INSERT_COLUMNS}', 1)) AS list FROM captured_sql
    UNION ALL SELECT event_id, 3, unnest(regexp_extract_all(sql_text, '{sqltext.SET_COLUMNS}', 1)) FROM captured_sql) lists),
cleaned AS (SELECT event_id, src, t, CASE WHEN src = 1 THEN c ELSE regexp_replace(regexp_replace(trim(c), '\\s*=.*$', '', 's'), '[`"''\\[\\]]', '', 'g') END AS c FROM refs),
kept AS (SELECT event_id, t, c, min(src) AS src FROM cleaned WHERE c <> '' AND upper(c) NOT IN ({_KEYWORDS}) AND (t IS NULL OR upper(t) NOT IN ({_KEYWORDS})) GROUP BY event_id, t, c)"""


def _sql(select: str) -> str:
    return with_views(f"SELECT event_id, {select} FROM captured_sql", "access_log", "captured_sql")


def _over_refs(sql: str) -> str:
    return with_views("", "access_log", "captured_sql").rstrip() + ", " + _REFS + " " + sql


def _calls(select: str) -> str:
    return with_views(f"SELECT call_id, {select} FROM call_texts", "calls", "call_texts")


ORACLES = {
    "sql_tables": _sql(_SORTED.format(_TABLES) + " AS tables"),
    "sql_operation": _sql(_OPERATION + " AS operation"),
    "sql_columns": _over_refs("""SELECT e.event_id, coalesce(string_agg(concat(coalesce(t, ''), ':', c, ':', CASE src WHEN 1 THEN 'SQL_SELECT' WHEN 2 THEN 'SQL_INSERT' ELSE 'SQL_UPDATE' END), ',' ORDER BY concat(coalesce(t, ''), ':', c, ':', CASE src WHEN 1 THEN 'SQL_SELECT' WHEN 2 THEN 'SQL_INSERT' ELSE 'SQL_UPDATE' END)) FILTER (WHERE k.c IS NOT NULL), '') AS columns
        FROM captured_sql e LEFT JOIN kept k ON e.event_id = k.event_id GROUP BY e.event_id"""),
    "sql_parsed": _over_refs(f"""SELECT s.event_id, s.table_name, s.operation, coalesce(string_agg(k.c, ',' ORDER BY k.c), '') AS columns
        FROM (SELECT event_id, {_OPERATION} AS operation, unnest({_TABLES}) AS table_name FROM captured_sql) s
        LEFT JOIN kept k ON s.event_id = k.event_id AND (k.t IS NULL OR k.t = s.table_name) GROUP BY s.event_id, s.table_name, s.operation"""),
    "sql_dialect_mysql": _sql(_SORTED.format(_MYSQL) + " AS tables, " + _SORTED.format("regexp_extract_all(sql_text, '`(\\w+)`\\.`(\\w+)`', 1)") + " AS schemas"),
    "sql_dialect_pg": _sql(_SORTED.format(_PG) + " AS tables, " + _SORTED.format("list_transform(list_filter(string_split(regexp_extract(sql_text, '(?is)RETURNING\\s+(.+?)(?:;|$)', 1), ','), lambda c: trim(c) <> ''), lambda c: trim(c))") + " AS returning"),
    "sql_by_dialect": _sql(f"{_DB_TYPE} AS db_type, CASE {_DB_TYPE} WHEN 'MYSQL' THEN {_SORTED.format(_MYSQL)} WHEN 'POSTGRESQL' THEN {_SORTED.format(_PG)} ELSE {_SORTED.format(_TABLES)} END AS tables, left(sql_text, 500) AS sql_500"),
    "url_path": _calls("""CASE WHEN expression LIKE '%http://%' THEN regexp_extract(expression, 'http://[^/]*(/[^"]*)"', 1) WHEN expression LIKE '%https://%' THEN regexp_extract(expression, 'https://[^/]*(/[^,]*),', 1) END AS path"""),
    "rpc_method": _calls("CASE WHEN expression LIKE '%dubbo%' THEN regexp_extract(expression, '\\.([^.(]*)\\([^.]*$', 1) END AS method"),
    "name_parts": with_views(f"SELECT method_id, concat('app-', app_id) AS app, concat(b, 'm', method_id) AS name, replace(class_name, ' ', '_') AS class, concat(b, signature) AS sig, o AS operation FROM methods JOIN (VALUES {', '.join(f"({i}, '{b}', '{o}')" for i, (b, o) in enumerate(BEGINNINGS.items()))}) x(i, b, o) ON method_id % {len(BEGINNINGS)} = i", "methods"),
}
ORACLES["sql_products"] = "SELECT event_id, CASE user_id % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PRODUCTS)) + " END AS product, CASE user_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PRODUCTS.values())) + " END AS db_type FROM events"
