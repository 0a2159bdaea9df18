"""Facts that SQL text gives away to regular expressions: tables, columns, operation, dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and the word list decide which names count.
TABLES = r'(?i)(?:FROM|JOIN|INTO|UPDATE|INSERT\s+INTO)\s+`?"?([\w.]+)`?"?'
PLAIN_TABLES = r"(?i)(?:FROM|JOIN|INTO|UPDATE|INSERT\s+INTO)\s+(\w+)"
PG_TABLES = r'(?i)(?:FROM|JOIN|INTO|UPDATE|INSERT\s+INTO)\s+"?(\w+)"?'
BACKTICK_TABLES = r"(?i)(?:FROM|JOIN|INTO|UPDATE|INSERT\s+(?:IGNORE\s+)?INTO|REPLACE\s+INTO)\s+`(\w+)`"
SCHEMA_TABLES = r"(?i)`(\w+)`\.`(\w+)`"
CTE_NAMES = r"(?i)WITH\s+(\w+)\s+AS\s*\("
RETURNING = r"(?is)RETURNING\s+(.+?)(?:;|$)"
OPERATION = r"(?i)^(SELECT|INSERT|UPDATE|DELETE|MERGE|UPSERT|REPLACE|TRUNCATE|CREATE|ALTER|DROP)"
QUALIFIED = r"(?i)(\w+)\.(\w+)"
INSERT_COLUMNS = r"(?is)INSERT\s+(?:INTO\s+)?\w+\s*\((.+?)\)\s*(?:VALUES|SELECT|SET)"
SET_COLUMNS = r"(?is)SET\s+(.+?)(?:\s+WHERE|$)"
KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "ON", "AND", "OR", "NOT", "IN", "EXISTS", "BETWEEN", "LIKE", "INSERT", "UPDATE", "DELETE", "INTO", "VALUES", "SET",
    "ORDER", "BY", "GROUP", "HAVING", "LIMIT", "OFFSET", "AS", "DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "END", "UNION", "ALL", "NULL", "TRUE", "FALSE", "IS", "ASC", "DESC",
    "COUNT", "SUM", "AVG", "MAX", "MIN", "COALESCE", "CAST", "WITH", "RECURSIVE", "RETURNING", "DUAL",
)


def once(value: Column, use) -> Column:
    """use(value), the value worked out once however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def found(sql: Column, pattern: str, group: int = 1) -> Column:
    """The group of every match, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(pattern), F.lit(group)))


def is_name(word: Column) -> Column:
    return (word != "") & ~F.upper(word).isin(list(KEYWORDS))


def _bare(name: Column, marks: str) -> Column:
    return F.translate(name, marks, "")


def table_names(sql: Column) -> Column:
    """Tables by the dialect-free rule; a name after FROM, JOIN, INTO or UPDATE, quoted or not. DUAL is none."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.trim(sql), F.lit(TABLES), F.lit(1)), lambda t: _bare(t, '`"[]')))
    return F.filter(names, lambda t: F.upper(t) != "DUAL")


def mysql_tables(sql: Column) -> Column:
    return F.array_union(table_names(sql), found(sql, BACKTICK_TABLES))


def mysql_schemas(sql: Column) -> Column:
    """Map of table to schema for `schema`.`table`; of repeated tables the last counts."""
    tables, schemas = F.regexp_extract_all(sql, F.lit(SCHEMA_TABLES), F.lit(2)), F.regexp_extract_all(sql, F.lit(SCHEMA_TABLES), F.lit(1))
    last = once(F.arrays_zip(tables.alias("t"), schemas.alias("s")), lambda pairs: F.filter(pairs, lambda p, i: ~F.array_contains(F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["t"]), p["t"])))
    return once(last, lambda kept: F.map_from_arrays(F.transform(kept, lambda p: p["t"]), F.transform(kept, lambda p: p["s"])))


def cte_names(sql: Column) -> Column:
    return F.transform(found(sql, CTE_NAMES), F.lower)


def pg_tables(sql: Column) -> Column:
    """PostgreSQL: the dialect-free names and those of quoted words, without the first common table expression's."""
    quoted = F.filter(found(sql, PG_TABLES), lambda t: F.upper(t) != "DUAL")
    return F.array_except(F.array_union(table_names(sql), quoted), cte_names(sql))


def returning_columns(sql: Column) -> Column:
    listed = F.split(F.regexp_extract(sql, RETURNING, 1), ",")
    names = F.transform(listed, lambda c: _bare(F.split(F.trim(c), r"\s+")[0], '"'))
    return F.filter(names, lambda c: (c != "") & (c != "*"))


def operation(sql: Column) -> Column:
    """SELECT, INSERT, UPDATE or DELETE by the first word."""
    word = F.upper(F.regexp_extract(F.trim(sql), OPERATION, 1))
    return F.when(word.isin("INSERT", "REPLACE", "UPSERT"), "INSERT").when(word.isin("UPDATE", "MERGE"), "UPDATE").when(word.isin("DELETE", "TRUNCATE"), "DELETE").otherwise("SELECT")


def column_refs(sql: Column) -> Column:
    """Array of (table, column, source), each table.column once: qualified names, then INSERT lists, then SET lists."""
    sql = F.trim(sql)
    row = lambda t, c, s: F.struct(t.alias("table"), c.alias("column"), F.lit(s).alias("source"))
    parts = lambda x: (F.substring_index(x, ".", 1), F.substring_index(x, ".", -1))
    both = F.regexp_extract_all(sql, F.lit(QUALIFIED), F.lit(0))
    qualified = F.transform(F.filter(both, lambda x: is_name(parts(x)[0]) & is_name(parts(x)[1])), lambda x: row(*parts(x), "SQL_SELECT"))
    none = F.lit(None).cast("string")
    lists = F.flatten(F.transform(F.regexp_extract_all(sql, F.lit(INSERT_COLUMNS), F.lit(1)), lambda x: F.split(x, ",")))
    inserted = F.transform(F.filter(F.transform(lists, lambda c: _bare(F.trim(c), "`\"'[]")), is_name), lambda c: row(none, c, "SQL_INSERT"))
    pairs = F.flatten(F.transform(F.regexp_extract_all(sql, F.lit(SET_COLUMNS), F.lit(1)), lambda x: F.split(x, ",")))
    updated = F.transform(F.filter(F.transform(pairs, lambda c: _bare(F.split(F.trim(c), r"\s*=\s*")[0], "`\"'[]")), is_name), lambda c: row(none, c, "SQL_UPDATE"))
    same = lambda q, r: (q["column"] == r["column"]) & q["table"].eqNullSafe(r["table"])
    return once(F.concat(qualified, inserted, updated), lambda every: F.filter(every, lambda r, i: ~F.exists(F.slice(every, F.lit(1), i), lambda q: same(q, r))))


def columns_of(refs: Column, table: Column) -> Column:
    """Columns of one table: those qualified with its very name, and unqualified ones."""
    return F.transform(F.filter(refs, lambda r: r["table"].isNull() | (r["table"] == table)), lambda r: r["column"])


def db_type(url: Column) -> Column:
    """MYSQL, POSTGRESQL, DB2, ORACLE, SQLSERVER or GENERIC by a JDBC URL."""
    u = F.lower(url)
    return F.when(u.contains("mysql"), "MYSQL").when(u.contains("postgresql") | u.contains("pgsql"), "POSTGRESQL").when(u.contains("db2"), "DB2").when(u.contains("oracle"), "ORACLE").when(u.contains("sqlserver"), "SQLSERVER").otherwise("GENERIC")


def db_type_of_product(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("mysql"), "MYSQL").when(n.contains("postgresql"), "POSTGRESQL").when(n.contains("db2"), "DB2").when(n.contains("oracle"), "ORACLE").when(n.contains("sql server") | n.contains("microsoft"), "SQLSERVER").otherwise("GENERIC")


def dialect_tables(kind: Column, sql: Column) -> Column:
    """Tables by the rule of the database type."""
    pg = pg_tables(sql)
    return F.when(kind == "MYSQL", mysql_tables(sql)).when(kind == "POSTGRESQL", F.when(F.size(pg) > 0, pg).otherwise(table_names(sql))).otherwise(table_names(sql))


def operation_of_name(name: Column) -> Column:
    """Operation by a method name's first letters."""
    n = F.lower(name)
    return F.when(n.rlike("^(delete|remove)"), "DELETE").when(n.rlike("^(update|modify)"), "UPDATE").when(n.rlike("^(insert|save|create|add)"), "INSERT").otherwise("SELECT")
