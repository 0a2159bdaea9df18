"""Mapper interfaces, their row types and tables, found in source texts and mapper XML by patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import names, sqltext
from sparkloom.scratch import saved

# How mappers, tables, fields and columns are declared, and the fields that are no columns.
MAPPER = r"interface\s+(\w+)\s+extends\s+BaseMapper<\s*(\w+)\s*>"
TABLE = r'@TableName\s*\(\s*(?:value\s*=\s*)?"([^"]+)"'
FIELD = r"(?:private|protected|public)\s+(?:final\s+)?(\w+Mapper)\s+(\w+)"
PARAMETER = r"(\w+Mapper)\s+\w+\s*[,\)]"
ROW_FIELD = r"private\s+\S+\s+(\w+)\s*;"
CLASS = r"(?:class|interface|record)\s+(\w+)"
SKIPPED = ["serialVersionUID", "id"]
TAG = r'</?[A-Za-z][\w.:-]*(?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|\'[^\']*\'))*\s*/?>'
INCLUDE = r'<include\s[^>]*?refid\s*=\s*"([^"]+)"[^>]*?(?:/>|>\s*</include\s*>)'
STATEMENTS = ["select", "insert", "update", "delete", "sql", "resultMap", "parameterMap"]
INSERTS, UPDATES, DELETES = ["insert", "save"], ["update", "updatebyid"], ["delete", "deletebyid", "deletebatchids", "deletebymap"]


def discovered(files: DataFrame) -> DataFrame:
    """mapper, row_type, table_name, columns (sorted, comma-joined): every mapper with its row type's table and columns."""
    text = F.col("content")
    mappers = files.select(F.regexp_extract(text, MAPPER, 1).alias("mapper"), F.regexp_extract(text, MAPPER, 2).alias("row_type")).where("mapper <> ''")
    listed = F.array_sort(F.array_except(F.regexp_extract_all(text, F.lit(ROW_FIELD), F.lit(1)), F.array(*map(F.lit, SKIPPED))))
    rows = files.select(F.regexp_extract(text, CLASS, 1).alias("row_type"), F.regexp_extract(text, TABLE, 1).alias("table_name"), F.array_join(listed, ",").alias("columns")).where("table_name <> ''")
    return mappers.join(rows, "row_type").select("mapper", "row_type", "table_name", "columns")


def usage(files: DataFrame, found: DataFrame) -> DataFrame:
    """package, class_name, variable, mapper, table_name: classes that hold a known mapper, by its simple name, in a field or (variable null) take it as a parameter alone."""
    text = F.col("content")
    fields = F.arrays_zip(F.regexp_extract_all(text, F.lit(FIELD), F.lit(1)).alias("mapper"), F.regexp_extract_all(text, F.lit(FIELD), F.lit(2)).alias("variable"))
    taken = F.array_except(F.regexp_extract_all(text, F.lit(PARAMETER), F.lit(1)), F.transform(fields, lambda f: f["mapper"]))
    all_of = F.concat(fields, F.transform(taken, lambda m: F.struct(m.alias("mapper"), F.lit(None).cast("string").alias("variable"))))
    held = files.select(F.regexp_extract(text, r"package\s+([\w.]+)\s*;", 1).alias("package"), F.regexp_extract(text, CLASS, 1).alias("class_name"), F.explode(all_of).alias("f"))
    held = held.select("package", "class_name", "f.mapper", "f.variable").where("class_name <> ''").distinct()
    known = found.select(names.simple_name(F.col("mapper")).alias("mapper"), "table_name", F.col("row_type").alias("skipped"))
    rows = held.join(known, "mapper").join(known.select(F.col("skipped").alias("class_name")).distinct(), "class_name", "left_anti")
    return rows.select("package", "class_name", "variable", "mapper", "table_name")


def mappers_of(methods: DataFrame, used: DataFrame) -> DataFrame:
    """method_id, mapper, table_name: the mappers that each method's class (method_id, class_name) uses.

    class_name names a class in full, else the end of one after a dot, else a simple name; of several classes that a
    name ends, the first by name counts.
    """
    full = F.when(F.col("package") == "", F.col("class_name")).otherwise(F.concat_ws(".", "package", "class_name"))
    held = used.select(full.alias("full"), "mapper", "table_name").distinct()
    classes = held.select("full").distinct()
    exact = methods.select("class_name").distinct().join(classes, F.col("class_name") == F.col("full")).select("class_name", "full")
    parts = F.split("full", r"\.")
    ends = classes.select("full", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))).alias("class_name"))
    by_end = methods.select("class_name").distinct().join(exact, "class_name", "left_anti").join(ends, "class_name").groupBy("class_name").agg(F.min("full").alias("full"))
    return methods.join(exact.unionByName(by_end), "class_name").join(held, "full").select("method_id", "mapper", "table_name").distinct()


def relations(methods: DataFrame, operations: DataFrame, used: DataFrame, found: DataFrame) -> DataFrame:
    """source, table_name, operation, columns, mapper: a row for each method and table of its class, and one of source `mapper:...` for each mapper whose table no method has.

    methods: method_id, class_name; operations: method_id, operation (SELECT where a method has none).
    """
    held = saved(mappers_of(methods, used))  # asked twice
    hits = held.join(operations, "method_id", "left")
    columns = found.select("table_name", "mapper", "columns")
    rows = hits.join(columns, ["table_name", "mapper"], "left").select(F.col("method_id").cast("string").alias("source"), "table_name", F.coalesce("operation", F.lit("SELECT")).alias("operation"), "columns", "mapper")
    unused = found.join(held.select("table_name").distinct(), "table_name", "left_anti")
    return rows.unionByName(unused.select(F.concat(F.lit("mapper:"), "mapper").alias("source"), "table_name", F.lit("SELECT").alias("operation"), "columns", "mapper"))


def without_stubs(rows: DataFrame) -> DataFrame:
    """The relations that come from methods."""
    return rows.where(~F.col("source").startswith("mapper:"))


def stubs(found: DataFrame, used: DataFrame) -> DataFrame:
    """mapper, table_name of mappers whose table no class uses."""
    return found.join(used.select("table_name").distinct(), "table_name", "left_anti").select("mapper", "table_name")


def operation_of_calls(calls: DataFrame, used: DataFrame) -> DataFrame:
    """path, caller, operation: for methods that call mappers, INSERT over DELETE over UPDATE over SELECT by the called names."""
    scopes = used.select(F.explode(F.array("variable", names.simple_name(F.col("mapper")))).alias("scope")).where("scope IS NOT NULL").distinct()
    calls = saved(calls.select("path", "caller", "scope", "name"))  # asked twice: files would be scanned again
    signatures = calls.join(scopes, "scope").select("name").distinct()
    hits = calls.join(signatures, "name")
    name = F.lower("name")
    rank = F.when(name.isin(INSERTS), 3).when(name.isin(DELETES), 2).when(name.isin(UPDATES), 1).otherwise(0)
    best = hits.groupBy("path", "caller").agg(F.max(rank).alias("rank"))
    return best.select("path", "caller", F.element_at(F.array(*map(F.lit, ["SELECT", "UPDATE", "DELETE", "INSERT"])), F.col("rank") + 1).alias("operation"))


def xml_operation(tag: Column) -> Column:
    t = F.lower(tag)
    return F.when(t.isin("insert", "update", "delete"), F.upper(t)).otherwise("SELECT")


#: Marks around the name of a fragment in a statement's text, and how far fragments may include others.
OPEN, CLOSE, DEEP = "\u2983", "\u2984", 3
_IDS = "struct<`_namespace`:string," + ",".join(f"`{t}`:array<struct<`_id`:string>>" for t in STATEMENTS) + ",`_corrupt_record`:string>"
_BODIES = "struct<" + ",".join(f"`{t}`:array<string>" for t in STATEMENTS) + ">"


def _statement(tag: str):
    return lambda p: F.struct(F.lit(tag).alias("tag"), p["i"]["_id"].alias("id"), p["b"].alias("body"))


def xml_files(files: DataFrame) -> DataFrame:
    """path, space, statements (array of tag, id, body), error: the mapper XML files of `files` (path, content) as Spark's XML reader takes them.

    Files whose path has no `mapper` in it, or another ending, are none. A file that is no well-formed XML has an error and
    no statements. Bodies are the inner XML of each statement and `sql` fragment, with the names of included fragments
    between marks; a doctype is left out unread.
    """
    files = files.where(F.col("path").contains("mapper") & F.col("path").endswith(".xml"))
    text = F.regexp_replace(F.regexp_replace("content", r"(?s)<!DOCTYPE\b[^\[>]*(?:\[.*?\]\s*)?>", ""), INCLUDE, f"{OPEN}$1{CLOSE}")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = files.select("path", text.alias("text"))
    rows = rows.select("path", F.from_xml("text", _IDS, options).alias("ids"), F.from_xml("text", _BODIES, options).alias("bodies"))
    every = []
    for tag in STATEMENTS:
        pairs = F.arrays_zip(F.col(f"ids.{tag}").alias("i"), F.col(f"bodies.{tag}").alias("b"))
        every.append(F.coalesce(F.transform(pairs, _statement(tag)), F.array().cast("array<struct<tag:string,id:string,body:string>>")))
    bad = F.col("ids").isNull() | F.col("ids._corrupt_record").isNotNull()
    found = F.when(bad, F.array().cast("array<struct<tag:string,id:string,body:string>>")).otherwise(F.concat(*every))
    return rows.select("path", F.when(~bad, F.coalesce("ids._namespace", F.lit(""))).alias("space"), found.alias("statements"), F.when(bad, "no well-formed XML").alias("error"))


def _plain(body: Column) -> Column:
    """The text of inner XML without its tags and comments, blanks drawn together."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), TAG, " "), r"\s+", " "))


def _included(rows: DataFrame, fragments: DataFrame) -> DataFrame:
    """`rows` (space, number, sql) with the text of each included fragment in place of its name, of the own file's space where the name has none; one of no such fragment is left out."""
    parts = F.split("sql", f"[{OPEN}{CLOSE}]")  # every second part is a name
    asked = rows.select("number", "space", F.posexplode(parts).alias("at", "part"))
    name = F.when(F.col("part").contains("."), F.col("part")).otherwise(F.concat_ws(".", "space", "part"))
    asked = asked.withColumn("name", F.when(F.col("at") % 2 == 1, name))
    met = asked.join(fragments, "name", "left").withColumn("part", F.when(F.col("name").isNull(), F.col("part")).otherwise(F.coalesce("fragment", F.lit(""))))
    joined = met.groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "").alias("filled"))
    return rows.join(joined, "number").withColumn("sql", F.trim(F.regexp_replace("filled", r"\s+", " "))).drop("filled")


def xml_statements(files: DataFrame) -> DataFrame:
    """source, operation, table_name, sql: statements of mapper XML files (path, content), a row for each table of each.

    Nested tags (`where`, `if`, `foreach`) add their text where they stand, and included fragments theirs, fragments of
    fragments too (DEEP levels); fragments count as statements of their own. A file that can't be read costs itself alone.
    """
    rows = xml_files(files).select("path", "space", F.posexplode("statements").alias("nth", "s"))
    rows = rows.select("space", F.col("s.tag").alias("tag"), F.col("s.id").alias("id"), _plain(F.col("s.body")).alias("sql"), F.struct("path", "nth").alias("number"))
    rows = saved(rows)
    fragments = rows.where("tag = 'sql'").groupBy(F.concat_ws(".", "space", "id").alias("name")).agg(F.min_by("sql", "number").alias("fragment"))
    marked = F.col("sql").contains(OPEN)
    for _ in range(DEEP):
        if rows.where(marked).isEmpty():
            break
        rows = saved(_included(rows.where(marked), fragments).unionByName(rows.where(~marked)))
    rows = rows.withColumn("sql", F.trim(F.regexp_replace(F.regexp_replace("sql", f"{OPEN}[^{CLOSE}]*{CLOSE}", " "), r"\s+", " ")))
    tables = F.array_distinct(F.regexp_extract_all("sql", F.lit(sqltext.PLAIN_TABLES), F.lit(1)))
    return rows.select(F.concat_ws(".", "space", "id").alias("source"), xml_operation(F.col("tag")).alias("operation"), F.explode(tables).alias("table_name"), "sql")


def all_relations(*parsers: DataFrame) -> DataFrame:
    """source, table_name, operation of all parsers, one after the other; what two of them find is there twice."""
    return reduce(DataFrame.unionByName, (p.select("source", "table_name", "operation") for p in parsers))
