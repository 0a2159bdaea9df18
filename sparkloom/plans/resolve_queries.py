"""Queries that resolve textual targets; the texts are derived from the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.fixture import VIEWS, views, whole_views, with_views, with_whole_views
from sparkloom.operators import resolve

VIEWS.update(
    named_methods="""
        SELECT method_id, app_id, is_entry, class_name, signature, concat('/api/m', method_id) AS path,
               concat('app-', app_id, ':shop.', replace(class_name, ' ', '_'), '.', signature) AS full_id FROM methods""",
    raw_calls="""
        SELECT c.call_id, c.src, c.call_type, CASE WHEN c.dst % 2 = 0 THEN m.full_id ELSE concat('shop.helper.m', c.dst, '(a)') END AS target
        FROM calls c JOIN named_methods m ON c.dst = m.method_id""",
    raw_accesses="""
        SELECT concat(a.method_id, '-', a.table_id, '-', a.operation) AS access_id, m.app_id, concat('t', a.table_id) AS table_name,
               CASE WHEN a.method_id % 2 = 0 THEN m.full_id ELSE concat('shop.Mapper.m', a.method_id) END AS source
        FROM (SELECT DISTINCT method_id, table_id, operation FROM accesses) a JOIN named_methods m ON a.method_id = m.method_id""",
    raw_callers="""
        SELECT c.call_id, CASE WHEN c.src % 3 = 0 THEN m.full_id WHEN c.src % 3 = 1 THEN concat('shop.helper.m', c.src, '(a)') ELSE 'shop.Other.run()' END AS source
        FROM calls c JOIN named_methods m ON c.src = m.method_id""",
    captures="""
        SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'ECONOMYService' ELSE concat('shop.C', user_id) END AS caller_class,
               CASE WHEN user_id % 2 = 0 THEN concat('m', user_id, '()') ELSE concat('m', user_id) END AS caller_method FROM access_log""",
)
_NAMED = ("methods", "calls", "accesses", "named_methods")


def _query(operator, *names, of=views):
    """A query of `operator` over the last of the named views and the named methods."""

    def query(spark, folder):
        found = of(spark, folder, *_NAMED, *names)
        return operator(found[-1], found[len(_NAMED) - 1])

    return query


def _external_only(texts, methods):
    return resolve.resolve_external(texts.where("call_type = 'EXTERNAL'"), methods)


def _first_of_prefix(methods, _):
    """For each beginning of two characters, the first method by id whose signature starts so."""
    wanted = methods.select(F.substring("signature", 1, 2).alias("name")).distinct()
    return resolve.by_prefix(wanted, methods, 1).select("name", "method_id")


QUERIES = {
    "calls_resolved": _query(resolve.resolve_calls, "raw_calls"),
    "accesses_exact": _query(resolve.accesses_exact, "raw_accesses"),
    "access_tables": _query(lambda raw, methods: resolve.access_tables(raw), "raw_accesses"),
    "accesses_prefix": _query(resolve.accesses_prefix, "raw_accesses"),
    "accesses_capture": _query(resolve.accesses_capture, "access_log", "captures"),
    "external_resolved": _query(_external_only, "call_texts"),
    "method_lookup": _query(_first_of_prefix),
    "methods_by_id": _query(lambda calls, methods: resolve.by_id(calls.select(F.col("target").alias("full_id")), methods).select("method_id", "full_id", "signature"), "raw_calls"),
    "callers_resolved": _query(resolve.resolve_callers, "raw_callers"),
}

def _entries(app=None):
    """Entry methods, of all apps or one, with path and verb."""
    return lambda named, _: resolve.entries(named.withColumn("http_method", F.lit("GET")), app)


#: Queries over the calls and accesses of every line item.
WHOLE = {
    "calls_resolved": (resolve.resolve_calls, "raw_calls"),
    "callers_resolved": (resolve.resolve_callers, "raw_callers"),
    "accesses_exact": (resolve.accesses_exact, "raw_accesses"),
    "access_tables": (lambda raw, methods: resolve.access_tables(raw), "raw_accesses"),
    "accesses_prefix": (resolve.accesses_prefix, "raw_accesses"),
    "external_resolved": (_external_only, "call_texts"),
}
QUERIES |= {f"whole_{name}": _query(operator, view, of=whole_views) for name, (operator, view) in WHOLE.items()}
QUERIES |= {"entry_projection": _query(_entries()), "entry_projection_of_app": _query(_entries(3))}


def _sql(sql: str, *names: str) -> str:
    return with_views(sql, *_NAMED, *names)


ORACLES = {
    "calls_resolved": with_views("", *_NAMED, "raw_calls").rstrip()
    + """, exact AS (SELECT r.call_id, r.src, m.method_id AS dst FROM raw_calls r JOIN named_methods m ON r.target = m.full_id WHERE r.src <> m.method_id),
    rest AS (SELECT r.*, s.app_id AS src_app, regexp_extract(target, '([^.(]*)\\(', 1) AS name FROM raw_calls r JOIN named_methods s ON r.src = s.method_id WHERE r.call_id NOT IN (SELECT call_id FROM exact)),
    names AS (SELECT DISTINCT name FROM rest),
    options AS (SELECT * FROM (SELECT n.name, m.method_id, m.app_id, row_number() OVER (PARTITION BY n.name ORDER BY m.method_id) AS nth FROM names n JOIN named_methods m ON starts_with(m.signature, n.name)) x WHERE nth <= 50),
    ranked AS (SELECT r.call_id, r.src, o.method_id AS dst, CASE WHEN o.app_id = r.src_app AND o.method_id <> r.src THEN 1 WHEN o.app_id = r.src_app THEN 2 WHEN r.call_type = 'EXTERNAL' AND o.method_id <> r.src THEN 3 WHEN r.call_type = 'EXTERNAL' THEN 4 END AS rank
      FROM rest r JOIN options o ON r.name = o.name),
    chosen AS (SELECT call_id, src, dst, row_number() OVER (PARTITION BY call_id ORDER BY rank, dst) AS nth FROM ranked WHERE rank IS NOT NULL)
    SELECT call_id, src, dst, 'exact' AS how FROM exact UNION ALL SELECT call_id, src, dst, 'prefix' FROM chosen WHERE nth = 1""",
    "accesses_exact": _sql("SELECT access_id, method_id FROM raw_accesses JOIN named_methods ON source = full_id", "raw_accesses"),
    "access_tables": _sql("SELECT DISTINCT concat('table:', app_id, ':', table_name) AS table_id, table_name FROM raw_accesses", "raw_accesses"),
    "accesses_prefix": _sql("""SELECT DISTINCT r.access_id, m.method_id FROM raw_accesses r JOIN named_methods m ON r.app_id = m.app_id AND (r.source = m.full_id
        OR starts_with(m.signature, CASE WHEN r.source LIKE '%(%' THEN regexp_extract(r.source, '([^.(]*)\\(', 1) ELSE regexp_extract(r.source, '([^.]*)$', 1) END))""", "raw_accesses"),
    "accesses_capture": _sql("""SELECT DISTINCT caller_class, caller_method, method_id FROM captures c JOIN named_methods m
        ON contains(m.full_id, concat(caller_class, '.', caller_method)) OR ends_with(m.full_id, caller_method) OR m.class_name = caller_class""", "access_log", "captures"),
    "external_resolved": with_views("", *_NAMED, "call_texts").rstrip()
    + """, parts AS (SELECT t.call_id, s.app_id AS src_app, CASE WHEN expression LIKE '%http://%' THEN regexp_extract(expression, 'http://[^/]*(/[^"]*)"', 1) WHEN expression LIKE '%https://%' THEN regexp_extract(expression, 'https://[^/]*(/[^,]*),', 1) END AS path,
        CASE WHEN expression LIKE '%dubbo%' THEN regexp_extract(expression, '\\.([^.(]*)\\([^.]*$', 1) END AS name FROM call_texts t JOIN methods s ON t.src = s.method_id WHERE call_type = 'EXTERNAL'),
    hits AS (SELECT p.call_id, m.method_id AS dst, 'HTTP' AS protocol FROM parts p JOIN named_methods m ON p.path = m.path AND m.is_entry AND m.app_id <> p.src_app
      UNION ALL SELECT p.call_id, m.method_id, 'Dubbo' FROM parts p JOIN named_methods m ON p.path IS NULL AND contains(m.class_name, p.name) AND m.is_entry AND m.app_id <> p.src_app)
    SELECT call_id, min(dst) AS dst, protocol FROM hits GROUP BY call_id, protocol""",
    "methods_by_id": _sql("SELECT method_id, full_id, signature FROM named_methods WHERE full_id IN (SELECT target FROM raw_calls)", "raw_calls"),
    "callers_resolved": _sql("""SELECT call_id, m.method_id AS src, 'exact' AS how FROM raw_callers JOIN named_methods m ON source = full_id
        UNION ALL SELECT call_id, min(m.method_id), 'prefix' FROM raw_callers r JOIN named_methods m ON starts_with(m.signature, regexp_extract(source, '([^.(]*)\\(', 1)) WHERE source NOT IN (SELECT full_id FROM named_methods) GROUP BY call_id""", "raw_callers"),
    "method_lookup": _sql("SELECT left(signature, 2) AS name, min(method_id) AS method_id FROM named_methods GROUP BY 1"),
}
ORACLES |= {f"whole_{name}": with_whole_views(ORACLES[name]) for name in WHOLE}
_PROJECTED = "SELECT method_id, app_id, signature, path AS http_path, 'GET' AS http_method, class_name FROM named_methods WHERE is_entry"
ORACLES |= {"entry_projection": _sql(_PROJECTED), "entry_projection_of_app": _sql(_PROJECTED + " AND app_id = 3")}
