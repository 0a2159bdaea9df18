"""Queries over the method/table graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.fixture import Graph, graph, views, whole_graph, with_views, with_whole_views
from sparkloom.operators import drawing, report, rules, sinks, topology, traverse
from sparkloom.scratch import fresh_path, saved

TRACE_DEPTH = 3


def _on(operator):
    return lambda spark, folder: operator(graph(spark, folder))


def _whole(operator):
    return lambda spark, folder: operator(whole_graph(spark, folder))


def _entries(g):
    return g.methods.where("is_entry").select("method_id")


def _upstream(spark, folder):
    """Entry methods upstream of every method that accesses a table."""
    g = graph(spark, folder)
    return traverse.upstream_entries(g, g.accesses.select("method_id").distinct())


def _impact(spark, folder):
    """What a change of any method that writes a table reaches."""
    g = graph(spark, folder)
    return traverse.impact(g, g.accesses.where("operation <> 'SELECT'").select("method_id").distinct(), 3)


def _downstream(spark, folder):
    g = graph(spark, folder)
    return traverse.impact(g, _entries(g), 3, upstream=False)


def _trace(spark, folder):
    g = graph(spark, folder)
    internal = type(g)(g.methods, g.calls.where("call_type = 'INTERNAL'"), g.accesses)
    return g, traverse.trace(internal, _entries(g), TRACE_DEPTH)


def _trace_visit(spark, folder):
    return _trace(spark, folder)[1][0].select("seed", F.col("node").alias("method_id"), "depth")


def _trace_edges(spark, folder):
    """The internal calls of every method that a trace visits before its last depth."""
    g, (visits, _) = _trace(spark, folder)
    calls = g.calls.where("call_type = 'INTERNAL'")
    return visits.where(F.col("depth") < TRACE_DEPTH).join(calls, F.col("node") == F.col("src")).select("seed", "src", "dst", "call_id")


def _trace_tables(spark, folder):
    g, (visits, _) = _trace(spark, folder)
    return visits.join(g.accesses, F.col("node") == F.col("method_id")).select("seed", "method_id", "table_id", "operation")


def _trace_paths(spark, folder):
    return _trace(spark, folder)[1][1].select("seed", F.array_join("path", ">").alias("path"), "end")


def _trace_tree(spark, folder):
    return _tree(_trace(spark, folder)[1][1])


def _tree(paths):
    """Per seed: the root, all paths as one JSON array, and their number."""
    by = paths.groupBy("seed").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return by.select("seed", F.col("paths")[0][0].alias("root"), F.to_json("paths").alias("paths"), F.size("paths").cast("long").alias("total_paths"))


def _edge(a, b, kind, subtype=None):
    more = [] if subtype is None else [subtype.alias("subType")]
    return F.to_json(F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), *more))


def _trace_graph(spark, folder):
    g, (visits, _) = _trace(spark, folder)
    calls = visits.where(F.col("depth") < TRACE_DEPTH).join(g.calls.where("call_type = 'INTERNAL'"), F.col("node") == F.col("src"))
    return _drawn(g, visits, calls.select("seed", F.lit("edge").alias("part"), _edge(F.col("src").cast("string"), F.col("dst").cast("string"), "CALLS").alias("json")))


def _drawn(g, visits, calls):
    """Nodes and edges of every trace as JSON for drawing: methods with their class as the group, tables, calls (as given) and accesses."""
    known = visits.join(g.methods, F.col("node") == F.col("method_id"))
    node = lambda i, kind, label, group: F.to_json(F.struct(i.alias("id"), F.lit(kind).alias("type"), label.alias("label"), group.alias("comboId")))
    table = F.concat(F.lit("table:"), F.col("table_id").cast("string"))
    methods = known.select("seed", F.lit("node").alias("part"), node(F.col("method_id").cast("string"), "METHOD", F.concat_ws(".", "class_name", "signature"), F.col("class_name")).alias("json"))
    hits = visits.join(g.accesses, F.col("node") == F.col("method_id"))
    tables = hits.select("seed", F.lit("node").alias("part"), node(table, "TABLE", table, F.lit(None).cast("string")).alias("json"))
    uses = hits.select("seed", F.lit("edge").alias("part"), _edge(F.col("method_id").cast("string"), table, "ACCESSES").alias("json"))
    return methods.unionByName(tables).unionByName(uses).unionByName(calls)


def _findings(spark, folder):
    return rules.findings(graph(spark, folder))


def _findings_of_apps(spark, folder):
    """The ten newest findings of each app, by the newest method."""
    g = graph(spark, folder)
    found = rules.findings(g).join(g.methods.select("method_id", "app_id"), "method_id")
    top = sinks.newest_of_each(found, ["app_id"], 10, [F.desc("method_id"), F.asc("title"), F.asc("description")])
    return top.select("app_id", "rule_id", "method_id", "title", "description")


def _upserted(spark, folder):
    """A second scan brings new signatures for some of the first scan's methods, and some methods more."""
    g = graph(spark, folder)
    first = g.methods.where("method_id % 2 = 0").select("method_id", "app_id", "signature")
    second = g.methods.where("method_id % 3 = 0").select("method_id", "app_id", F.concat(F.lit("v2_"), "signature").alias("signature"))
    return sinks.upsert(first, second, ["method_id"])


def _to_scan(spark, folder):
    """Classes of an app stand for apps: those without an entry method are still to be scanned."""
    g = graph(spark, folder)
    named = g.methods.select(F.concat_ws(":", F.col("app_id").cast("string"), "class_name").alias("app_id"), (F.col("is_entry") & (F.col("method_id") % 10 == 0)).alias("is_entry"))
    return sinks.apps_to_scan(named.select("app_id").distinct(), named)


def _digest(spark, folder):
    """The digest of three of the five rules, as its SQL has it; `_digest_all` takes all."""
    found = rules.findings(graph(spark, folder), ["god-method", "layer-violation", "orphan-code"]).withColumn("created", F.col("method_id"))
    return rules.digest(found)


def _digest_all(spark, folder):
    """The digest of the findings of all rules."""
    return rules.digest(rules.findings(graph(spark, folder)).withColumn("created", F.col("method_id")))


def _full_trace(spark, folder):
    """A trace from every entry over all calls, at the operator's own depth and hop cap."""
    g = graph(spark, folder)
    return g, traverse.trace(g, _entries(g))


def _full_trace_visit(spark, folder):
    return _full_trace(spark, folder)[1][0].select("seed", F.col("node").alias("method_id"), "depth")


def _full_trace_edges(spark, folder):
    """All calls of every method that a trace visits, followed or not, with their call type."""
    g, (visits, _) = _full_trace(spark, folder)
    return visits.join(g.calls, F.col("node") == F.col("src")).select("seed", "src", "dst", "call_id", "call_type")


def _full_trace_tree(spark, folder):
    return _tree(_full_trace(spark, folder)[1][1])


def _full_trace_graph(spark, folder):
    """Nodes and edges of every full trace, all calls of its methods with their call type as the subtype."""
    g, (visits, _) = _full_trace(spark, folder)
    calls = visits.join(g.calls, F.col("node") == F.col("src"))
    return _drawn(g, visits, calls.select("seed", F.lit("edge").alias("part"), _edge(F.col("src").cast("string"), F.col("dst").cast("string"), "CALLS", F.col("call_type")).alias("json")))


def _full_trace_tables(spark, folder):
    g, (visits, _) = _full_trace(spark, folder)
    return visits.join(g.accesses, F.col("node") == F.col("method_id")).select("seed", "method_id", "table_id", "operation")


def _full_trace_paths(spark, folder):
    return _full_trace(spark, folder)[1][1].select("seed", F.array_join("path", ">").alias("path"), "end")


def _full_trace_target(spark, folder):
    """All paths of every entry with a target: the largest method that its trace visits, so that a target is within reach."""
    g, (visits, _) = _full_trace(spark, folder)
    goal = visits.where("depth > 0").groupBy("seed").agg(F.max("node").alias("target"))
    paths = traverse.trace(g, _entries(g), target=goal)[1]
    return paths.join(goal, "seed", "left").select("seed", "target", F.array_join("path", ">").alias("path"), "end")


def _resolved(spark, folder):
    """A trace from every entry whose external calls go where their expressions lead: graph, resolved calls, visits, paths, followed."""
    methods, calls, accesses, named, texts = views(spark, folder, "methods", "calls", "accesses", "named_methods", "call_texts")
    path = F.when(F.col("is_entry"), F.concat(F.lit("/api/m"), "method_id"))
    methods = methods.withColumns({"package_name": F.concat(F.lit("shop.a"), "app_id"), "return_type": F.lit("void"), "http_path": path, "line_number": (F.col("method_id") % 100).cast("int")})
    g, found = drawing.through_resolver(Graph(methods, calls, accesses), texts, named)
    visits, paths, followed = traverse.trace_with_hops(g, _entries(g))
    return g, found, saved(visits), paths, saved(followed)  # drawing reads both several times


def _resolved_graph(spark, folder):
    g, found, visits, _, followed = _resolved(spark, folder)
    return drawing.draw(g, visits, followed, found)


def _resolved_methods(spark, folder):
    """The method view: no groups."""
    g, found, visits, _, followed = _resolved(spark, folder)
    return drawing.draw(g, visits, followed, found, "method")


def _resolved_raw(spark, folder):
    g, found, visits, paths, followed = _resolved(spark, folder)
    return drawing.raw(drawing.draw(g, visits, followed, found), paths)


def _full_impact(spark, folder):
    g = graph(spark, folder)
    return traverse.impact(g, g.accesses.where("operation <> 'SELECT'").select("method_id").distinct())


def _full_downstream(spark, folder):
    g = graph(spark, folder)
    return traverse.impact(g, _entries(g), upstream=False)


def _whole_impact(g):
    return traverse.impact(g, g.accesses.where("operation <> 'SELECT'").select("method_id").distinct())


def _whole_upstream(g):
    return traverse.upstream_entries(g, g.accesses.select("method_id").distinct())


def _kept_findings(spark, folder):
    """Findings of every app, appended run by run; the runs of the even apps are written again, which changes nothing. Newest of each app and rule read back."""
    g, path = graph(spark, folder), fresh_path(spark)
    found = saved(rules.findings(g).join(g.methods.select("method_id", "app_id"), "method_id").withColumn("created", F.col("method_id")))
    sinks.append_runs(found, path, "app_id")
    sinks.append_runs(found.where("app_id % 2 = 0"), path, "app_id")
    top = sinks.newest_of_each(sinks.history(spark, path), ["app_id", "rule_id"], 3, [F.desc("created"), F.asc("title"), F.asc("description")])
    return top.select(F.col("app_id").cast("int"), "rule_id", "method_id", "title", "description")


def _kept_reports(spark, folder):
    """A prompt of each app's findings by rule, appended as a run an app, a second time for app 1; read back with how many there are."""
    g, path = graph(spark, folder), fresh_path(spark)
    found = rules.findings(g).join(g.methods.select("method_id", "app_id"), "method_id")
    lines = found.groupBy("app_id").agg(F.array_sort(F.collect_set("rule_id")).alias("findings"), F.array_sort(F.collect_set(F.col("method_id"))).alias("ids"))
    rows = lines.select(F.concat(F.lit("app "), "app_id").alias("table"), F.lit("all").alias("columns"), F.transform("ids", lambda i: i.cast("string")).alias("methods"), F.lit("none").alias("endpoints"), "findings")
    prompts = saved(report.named_prompts("field_impact_analysis", rows).withColumnRenamed("table", "run"))
    sinks.append_runs(prompts, path)
    sinks.append_runs(prompts.where("run = 'app 1'"), path)
    return sinks.history(spark, path).select("run", "name", "prompt")


def _own_rule(spark, folder):
    """A rule of one's own beside two that are built in: methods that write more than one table."""
    rule = rules.Rule("many-writes", "LOW", "architecture", rules.many_writes, "Writes in {class_name}.{signature}", "Writes {n_tables} tables.", "Write one table a method.")
    return rules.findings(graph(spark, folder), ["orphan-code", "layer-violation", "many-writes"], own=[rule]).select("rule_id", "severity", "method_id", "title", "description")


def _rule_listing(spark, folder):
    """The registered rules with the number of their findings."""
    listed = spark.createDataFrame([(r.id, r.severity, r.category) for r in rules.RULES], "rule_id string, severity string, category string")
    return listed.join(rules.findings(graph(spark, folder)).groupBy("rule_id").agg(F.count("*").alias("n")), "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


QUERIES = {
    "entry_points": lambda spark, folder: graph(spark, folder).methods.where("is_entry").select("method_id", "app_id", "signature", "class_name"),
    "methods_per_app": _on(topology.methods_per_app),
    "graph_counts": _on(topology.graph_counts),
    "neighbours": _on(lambda g: g.calls.join(g.methods, F.col("dst") == F.col("method_id")).select("call_id", "src", "dst", "signature", "class_name")),
    "method_accesses": _on(lambda g: g.methods.join(g.accesses, "method_id").select("method_id", "signature", "table_id", "operation")),
    "degrees": _on(lambda g: topology.degrees(g).select("method_id", "out_deg", "in_deg")),
    "value_labels": _on(topology.value_labels),
    "value_groups": _on(lambda g: topology.labels_grouped(topology.value_labels(g))),
    "topology": _on(topology.topology),
    "n_plus_one": _on(rules.n_plus_one),
    "circular_dep": _on(rules.circular_dep),
    "orphan_code": _on(rules.orphan_code),
    "layer_violation": _on(rules.layer_violation),
    "findings": _findings,
    "findings_of_apps": _findings_of_apps,
    "findings_kept": _kept_findings,
    "reports_kept": _kept_reports,
    "findings_of_own_rule": _own_rule,
    "findings_of_app": lambda spark, folder: rules.findings(graph(spark, folder), app=3).select("rule_id", "method_id", "title", "description"),
    "methods_upsert": _upserted,
    "apps_to_scan": _to_scan,
    "scan_stats": _on(topology.scan_stats),
    "callers": _on(lambda g: g.calls.join(g.methods, F.col("src") == F.col("method_id")).select("call_id", "src", "dst", "signature", "class_name")),
    "findings_digest": _digest,
    "findings_digest_all": _digest_all,
    "rule_listing": _rule_listing,
    "upstream_entry_points": _upstream,
    "impact": _impact,
    "impact_downstream": _downstream,
    "trace_visit": _trace_visit,
    "trace_edges": _trace_edges,
    "trace_tables": _trace_tables,
    "trace_paths": _trace_paths,
    "trace_tree": _trace_tree,
    "trace_graph": _trace_graph,
    "whole_graph_counts": _whole(topology.graph_counts),
    "whole_degrees": _whole(lambda g: topology.degrees(g).select("method_id", "out_deg", "in_deg")),
    "whole_value_labels": _whole(topology.value_labels),
    "whole_topology": _whole(topology.topology),
    "whole_god_method": _whole(rules.god_method),
    "whole_n_plus_one": _whole(rules.n_plus_one),
    "whole_neighbours": _whole(lambda g: g.calls.join(g.methods, F.col("dst") == F.col("method_id")).select("call_id", "src", "dst", "signature", "class_name")),
    "whole_callers": _whole(lambda g: g.calls.join(g.methods, F.col("src") == F.col("method_id")).select("call_id", "src", "dst", "signature", "class_name")),
    "whole_method_accesses": _whole(lambda g: g.methods.join(g.accesses, "method_id").select("method_id", "signature", "table_id", "operation")),
    "whole_scan_stats": _whole(topology.scan_stats),
    "circular_dep_first": _on(lambda g: rules.circular_dep(g, first=50)),
    "circular_dep_counts": _on(lambda g: traverse.trail_counts(g.calls, 2, 5)),
    "whole_circular_dep_first": _whole(lambda g: rules.circular_dep(g, first=50)),
    "whole_circular_dep_counts": _whole(lambda g: traverse.trail_counts(g.calls, 2, 5)),
    "whole_impact": _whole(_whole_impact),
    "whole_impact_downstream": _whole(lambda g: traverse.impact(g, _entries(g), upstream=False)),
    "whole_upstream_entry_points": _whole(_whole_upstream),
    "whole_orphan_code": _whole(rules.orphan_code),
    "whole_layer_violation": _whole(rules.layer_violation),
    "full_trace_visit": _full_trace_visit,
    "full_trace_edges": _full_trace_edges,
    "full_trace_tree": _full_trace_tree,
    "full_trace_graph": _full_trace_graph,
    "full_trace_tables": _full_trace_tables,
    "full_trace_paths": _full_trace_paths,
    "full_trace_target": _full_trace_target,
    "resolved_trace_graph": _resolved_graph,
    "resolved_trace_methods": _resolved_methods,
    "resolved_trace_raw": _resolved_raw,
    "full_impact": _full_impact,
    "full_impact_downstream": _full_downstream,
}

_DEG = """deg AS (SELECT m.*, coalesce(o.n, 0) AS out_deg, coalesce(i.n, 0) AS in_deg FROM methods m
  LEFT JOIN (SELECT src, count(DISTINCT call_id) AS n FROM calls GROUP BY src) o ON m.method_id = o.src
  LEFT JOIN (SELECT dst, count(DISTINCT call_id) AS n FROM calls GROUP BY dst) i ON m.method_id = i.dst)"""
_LABELS = """labels_ AS ((SELECT method_id, signature, class_name, 'HIGH_IMPACT' AS label, out_deg + in_deg AS score, concat('out=', out_deg, ' in=', in_deg) AS reason FROM deg WHERE out_deg + in_deg > 5 ORDER BY score DESC, method_id LIMIT 100)
  UNION ALL (SELECT method_id, signature, class_name, 'DEPRECATED_SUSPECT', CAST(0 AS BIGINT), 'no callers or callees' FROM deg WHERE out_deg + in_deg = 0 AND NOT is_entry ORDER BY method_id LIMIT 100)
  UNION ALL (SELECT method_id, signature, class_name, 'CRITICAL_PATH', out_deg + in_deg AS score, concat('out=', out_deg, ' in=', in_deg) FROM deg WHERE out_deg >= 3 AND in_deg >= 3 ORDER BY score DESC, method_id LIMIT 100))"""
_ALL = ("methods", "calls", "accesses")


def _sql(sql: str, *more: str) -> str:
    return with_views("", *_ALL).rstrip() + "".join(", " + m for m in more) + " " + sql


_CYCLE = """looping AS (SELECT src AS method_id FROM calls WHERE src = dst UNION SELECT a.src FROM calls a JOIN calls b ON a.dst = b.src WHERE b.dst = a.src
  UNION SELECT a.src FROM (SELECT DISTINCT src, dst FROM calls) a JOIN (SELECT DISTINCT src, dst FROM calls) b ON a.dst = b.src JOIN (SELECT DISTINCT src, dst FROM calls) c ON b.dst = c.src WHERE c.dst = a.src)"""
_TRAILS = """trails AS (SELECT src AS start, dst AS at, [call_id] AS used, concat(src, '>', dst) AS cycle, 1 AS depth FROM calls
  UNION ALL SELECT t.start, c.dst, list_append(t.used, c.call_id), concat(t.cycle, '>', c.dst), t.depth + 1 FROM trails t JOIN calls c ON t.at = c.src WHERE t.depth < 5 AND NOT list_contains(t.used, c.call_id))"""


def _reach(name: str, seeds: str, a: str, b: str, most: int, where: str = "true") -> str:
    return f"""{name}_walk AS (SELECT seed, seed AS node, 0 AS depth FROM ({seeds}) s UNION SELECT w.seed, c.{b}, w.depth + 1 FROM {name}_walk w JOIN calls c ON w.node = c.{a} AND {where} WHERE w.depth < {most}),
    {name} AS (SELECT seed, node, min(depth) AS depth FROM {name}_walk GROUP BY seed, node)"""


_TRACE = _reach("visited", "SELECT method_id AS seed FROM methods WHERE is_entry", "src", "dst", TRACE_DEPTH, "c.call_type = 'INTERNAL'")
_GOD = """SELECT m.method_id, m.signature, m.class_name, t.tables, t.n_tables FROM methods m JOIN (SELECT method_id, string_agg(CAST(table_id AS VARCHAR), ',' ORDER BY table_id) AS tables, count(*) AS n_tables
  FROM (SELECT DISTINCT method_id, table_id FROM accesses) d GROUP BY method_id HAVING count(*) >= 5) t ON m.method_id = t.method_id"""
GOD_METHOD = _sql(_GOD)
_NPLUS = "SELECT m.method_id, m.signature, m.class_name, a.table_id, a.operation FROM methods m JOIN accesses a ON m.method_id = a.method_id WHERE m.method_id IN (SELECT method_id FROM looping)"
_CIRC = "SELECT m.method_id, m.signature, m.class_name, t.cycle, t.depth FROM trails t JOIN methods m ON t.start = m.method_id WHERE t.start = t.at AND t.depth BETWEEN 2 AND 5"
_ORPHAN = "SELECT method_id, signature, class_name FROM methods WHERE NOT is_entry AND method_id NOT IN (SELECT dst FROM calls)"
_LAYER = "SELECT m.method_id, m.signature, m.class_name, a.table_id, a.operation FROM methods m JOIN accesses a ON m.method_id = a.method_id WHERE m.is_entry AND m.class_name LIKE '%Controller%'"


def _json(*columns: str) -> str:
    """The inside of a JSON object, numbers (first mark #) bare."""
    return ", ',', ".join(f"""'"{c.lstrip("#")}":', {c[1:] if c[0] == "#" else f"""'"', {c}, '"'"""}""" for c in columns)


_ACCESS = _json("#method_id", "signature", "class_name", "#table_id", "operation")
_EVIDENCE = {
    "god-method": _json("#method_id", "signature", "class_name", "tables", "#n_tables"), "n-plus-one": _ACCESS, "layer-violation": _ACCESS,
    "circular-dep": _json("#method_id", "signature", "class_name", "cycle", "#depth"), "orphan-code": _json("#method_id", "signature", "class_name"),
}


def _rendered() -> str:
    out = []
    for rule in rules.RULES:
        text = lambda t: "concat(" + ", ".join(p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(t.replace("}", "{").split("{"))) + ")"
        rows = {"god-method": _GOD, "n-plus-one": _NPLUS, "circular-dep": _CIRC, "orphan-code": _ORPHAN, "layer-violation": _LAYER}[rule.id]
        out.append(f"SELECT '{rule.id}' AS rule_id, '{rule.severity}' AS severity, '{rule.category}' AS category, method_id, {text(rule.title)} AS title, {text(rule.description)} AS description, {text(rule.suggestion)} AS suggestion, concat('{{', {_EVIDENCE[rule.id]}, '}}') AS evidence FROM ({rows}) r")
    return "found AS (" + " UNION ALL ".join(out) + ")"


ORACLES = {
    "entry_points": _sql("SELECT method_id, app_id, signature, class_name FROM methods WHERE is_entry"),
    "methods_per_app": _sql("SELECT app_id, count(*) AS n_methods FROM methods GROUP BY app_id"),
    "graph_counts": _sql("SELECT 'methods' AS kind, count(*) AS n FROM methods UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'accesses', count(*) FROM accesses UNION ALL SELECT 'tables', count(DISTINCT table_id) FROM accesses"),
    "neighbours": _sql("SELECT call_id, src, dst, signature, class_name FROM calls JOIN methods ON dst = method_id"),
    "method_accesses": _sql("SELECT m.method_id, signature, table_id, operation FROM methods m JOIN accesses a ON m.method_id = a.method_id"),
    "degrees": _sql("SELECT method_id, out_deg, in_deg FROM deg", _DEG),
    "value_labels": _sql("SELECT * FROM labels_", _DEG, _LABELS),
    "value_groups": _sql("SELECT label, string_agg(CAST(method_id AS VARCHAR), ',' ORDER BY method_id) AS methods, count(*) AS n FROM labels_ GROUP BY label", _DEG, _LABELS),
    "topology": _sql("SELECT s.app_id AS src_app, d.app_id AS dst_app, count(*) AS n_calls, CAST(least(5, 1 + count(*) // 5) AS INTEGER) AS line_width FROM calls c JOIN methods s ON c.src = s.method_id JOIN methods d ON c.dst = d.method_id WHERE call_type = 'EXTERNAL' AND s.app_id <> d.app_id GROUP BY s.app_id, d.app_id"),
    "n_plus_one": _sql(_NPLUS, _CYCLE),
    "circular_dep": _sql(_CIRC, _TRAILS),
    "orphan_code": _sql(_ORPHAN),
    "layer_violation": _sql(_LAYER),
    "findings": _sql("SELECT * FROM found", _CYCLE, _TRAILS, _rendered()),
    "findings_of_apps": _sql("""SELECT app_id, rule_id, method_id, title, description FROM (SELECT f.*, m.app_id, row_number() OVER (PARTITION BY m.app_id ORDER BY f.method_id DESC, title, description) AS nth FROM found f JOIN methods m ON f.method_id = m.method_id) x WHERE nth <= 10""", _CYCLE, _TRAILS, _rendered()),
    "findings_of_app": _sql("SELECT rule_id, f.method_id, title, description FROM found f JOIN methods m ON f.method_id = m.method_id WHERE app_id = 3", _CYCLE, _TRAILS, _rendered()),
    "methods_upsert": _sql("SELECT method_id, app_id, CASE WHEN method_id % 3 = 0 THEN concat('v2_', signature) ELSE signature END AS signature FROM methods WHERE method_id % 2 = 0 OR method_id % 3 = 0"),
    "apps_to_scan": _sql("SELECT concat(app_id, ':', class_name) AS app_id FROM methods GROUP BY 1 HAVING NOT bool_or(is_entry AND method_id % 10 = 0)"),
    "scan_stats": _sql("""SELECT app_id, count(*) FILTER (WHERE is_entry) AS entries, count(*) AS methods, CAST(sum((SELECT count(*) FROM calls WHERE src = method_id)) AS BIGINT) AS relations, CAST(sum((SELECT count(*) FROM accesses a WHERE a.method_id = m.method_id)) AS BIGINT) AS sql_relations,
        (SELECT count(DISTINCT table_id) FROM accesses a JOIN methods o ON a.method_id = o.method_id WHERE o.app_id = m.app_id) AS tables FROM methods m GROUP BY app_id"""),
    "callers": _sql("SELECT call_id, src, dst, signature, class_name FROM calls JOIN methods ON src = method_id"),
    "findings_digest": _sql("""SELECT string_agg(line, chr(10) ORDER BY method_id DESC, title) AS digest, count(*) AS n FROM (SELECT method_id, title, concat('- [', severity, '] ', title) AS line FROM found WHERE rule_id IN ('god-method', 'layer-violation', 'orphan-code') ORDER BY method_id DESC, title LIMIT 15) x""", _CYCLE, _TRAILS, _rendered()),
    "findings_digest_all": _sql("""SELECT string_agg(line, chr(10) ORDER BY method_id DESC, title) AS digest, count(*) AS n FROM (SELECT method_id, title, concat('- [', severity, '] ', title) AS line FROM found ORDER BY method_id DESC, title LIMIT 15) x""", _CYCLE, _TRAILS, _rendered()),
    "rule_listing": _sql("SELECT r.rule_id, r.severity, r.category, count(f.rule_id) AS n FROM (VALUES " + ", ".join(f"('{r.id}', '{r.severity}', '{r.category}')" for r in rules.RULES) + ") r(rule_id, severity, category) LEFT JOIN found f ON r.rule_id = f.rule_id GROUP BY ALL", _CYCLE, _TRAILS, _rendered()),
    "upstream_entry_points": _sql("""SELECT start, entry, depth FROM (SELECT r.seed AS start, r.node AS entry, r.depth, row_number() OVER (PARTITION BY r.seed ORDER BY r.node) AS n
        FROM up r JOIN methods s ON r.seed = s.method_id JOIN methods e ON r.node = e.method_id WHERE r.depth > 0 AND e.is_entry AND e.app_id = s.app_id) x WHERE n <= 50""", _reach("up", "SELECT DISTINCT method_id AS seed FROM accesses", "dst", "src", 6)),
    "impact": _sql("SELECT seed AS changed, count(*) AS n_methods, count(*) FILTER (WHERE is_entry) AS n_entries FROM up JOIN methods ON node = method_id WHERE node <> seed GROUP BY seed", _reach("up", "SELECT DISTINCT method_id AS seed FROM accesses WHERE operation <> 'SELECT'", "dst", "src", 3)),
    "impact_downstream": _sql("SELECT seed AS changed, count(*) AS n_methods, count(*) FILTER (WHERE is_entry) AS n_entries FROM down JOIN methods ON node = method_id WHERE node <> seed GROUP BY seed", _reach("down", "SELECT method_id AS seed FROM methods WHERE is_entry", "src", "dst", 3)),
    "trace_visit": _sql("SELECT seed, node AS method_id, depth FROM visited", _TRACE),
    "trace_edges": _sql(f"SELECT seed, src, dst, call_id FROM visited JOIN calls ON node = src AND call_type = 'INTERNAL' WHERE depth < {TRACE_DEPTH}", _TRACE),
    "trace_tables": _sql("SELECT seed, method_id, table_id, operation FROM visited JOIN accesses ON node = method_id", _TRACE),
    "trace_graph": _sql(
        f"""SELECT seed, 'node' AS part, concat('{{"id":"', method_id, '","type":"METHOD","label":"', class_name, '.', signature, '","comboId":"', class_name, '"}}') AS json FROM visited JOIN methods ON node = method_id
        UNION ALL SELECT seed, 'node', concat('{{"id":"table:', table_id, '","type":"TABLE","label":"table:', table_id, '"}}') FROM visited JOIN accesses ON node = method_id
        UNION ALL SELECT seed, 'edge', concat('{{"source":"', method_id, '","target":"table:', table_id, '","type":"ACCESSES"}}') FROM visited JOIN accesses ON node = method_id
        UNION ALL SELECT seed, 'edge', concat('{{"source":"', src, '","target":"', dst, '","type":"CALLS"}}') FROM visited JOIN calls ON node = src AND call_type = 'INTERNAL' WHERE depth < {TRACE_DEPTH}""",
        _TRACE,
    ),
}

_IMPACT = "SELECT seed AS changed, count(*) AS n_methods, count(*) FILTER (WHERE is_entry) AS n_entries FROM {0} JOIN methods ON node = method_id WHERE node <> seed GROUP BY seed"
ORACLES |= {
    "full_impact": _sql(_IMPACT.format("up"), _reach("up", "SELECT DISTINCT method_id AS seed FROM accesses WHERE operation <> 'SELECT'", "dst", "src", 6)),
    "full_impact_downstream": _sql(_IMPACT.format("down"), _reach("down", "SELECT method_id AS seed FROM methods WHERE is_entry", "src", "dst", 6)),
    "whole_graph_counts": with_whole_views(ORACLES["graph_counts"]),
    "whole_degrees": with_whole_views(ORACLES["degrees"]),
    "whole_value_labels": with_whole_views(ORACLES["value_labels"]),
    "whole_topology": with_whole_views(ORACLES["topology"]),
    "whole_god_method": with_whole_views(GOD_METHOD),
    "whole_orphan_code": with_whole_views(ORACLES["orphan_code"]),
    "whole_layer_violation": with_whole_views(ORACLES["layer_violation"]),
    "whole_n_plus_one": with_whole_views(ORACLES["n_plus_one"]),
}


def _levels(seeds: str, a: str, b: str, most: int) -> str:
    """found: seed, node, depth of the shortest ways, level by level over the distinct calls."""
    steps = [f"hops AS MATERIALIZED (SELECT DISTINCT {a} AS a, {b} AS b FROM calls)", f"l0 AS MATERIALIZED (SELECT DISTINCT seed, seed AS node, 0 AS depth FROM ({seeds}) s)"]
    for d in range(1, most + 1):
        steps.append(f"l{d} AS MATERIALIZED (SELECT * FROM l{d - 1} UNION ALL SELECT seed, node, {d} FROM (SELECT DISTINCT seed, b AS node FROM l{d - 1} JOIN hops ON node = a WHERE depth = {d - 1}) n WHERE NOT EXISTS (SELECT 1 FROM l{d - 1} o WHERE o.seed = n.seed AND o.node = n.node))")
    return ", ".join(steps) + f", found AS (SELECT * FROM l{most})"


_REACHED = "SELECT seed AS changed, count(*) AS n_methods, count(*) FILTER (WHERE is_entry) AS n_entries FROM found JOIN methods ON node = method_id WHERE node <> seed GROUP BY seed"
ORACLES |= {
    "whole_impact": with_whole_views(_sql(_REACHED, _levels("SELECT method_id AS seed FROM accesses WHERE operation <> 'SELECT'", "dst", "src", 6))),
    "whole_impact_downstream": with_whole_views(_sql(_REACHED, _levels("SELECT method_id AS seed FROM methods WHERE is_entry", "src", "dst", 6))),
    "whole_upstream_entry_points": with_whole_views(_sql("""SELECT start, entry, depth FROM (SELECT r.seed AS start, r.node AS entry, r.depth, row_number() OVER (PARTITION BY r.seed ORDER BY r.node) AS n
        FROM found r JOIN methods s ON r.seed = s.method_id JOIN methods e ON r.node = e.method_id WHERE r.depth > 0 AND e.is_entry AND e.app_id = s.app_id) x WHERE n <= 50""", _levels("SELECT method_id AS seed FROM accesses", "dst", "src", 6))),
}


def _trails(length: int, what: str) -> str:
    """Closed trails of `length` calls as one join of the numbered calls."""
    joins = "".join(f" JOIN c c{i} ON c{i}.src = c{i - 1}.dst" + "".join(f" AND c{i}.n <> c{j}.n" for j in range(i)) + (" AND c0.src = c%d.dst" % i if i == length - 1 else "") for i in range(1, length))
    return f"SELECT {what} FROM c c0{joins}"


_NUMBERED = "c AS MATERIALIZED (SELECT src, dst, row_number() OVER () AS n FROM calls)"
_COUNTED = " UNION ALL ".join(_trails(k, f"{k} AS depth, count(*) AS trails") for k in range(2, 6))
_NAMED_TRAILS = " UNION ALL ".join(_trails(k, "c0.src AS start, concat(" + ", '>', ".join(f"c{i}.src" for i in range(k)) + f", '>', c0.src) AS cycle, {k} AS depth") for k in range(2, 6))
_FIRST = f"SELECT m.method_id, m.signature, m.class_name, t.cycle, t.depth FROM (SELECT * FROM ({_NAMED_TRAILS}) a ORDER BY start, depth, cycle LIMIT 50) t JOIN methods m ON t.start = m.method_id"
ORACLES |= {
    "circular_dep_first": _sql(_FIRST, _NUMBERED),
    "circular_dep_counts": _sql(_COUNTED, _NUMBERED),
    "whole_circular_dep_first": with_whole_views(_sql(_FIRST, _NUMBERED)),
    "whole_circular_dep_counts": with_whole_views(_sql(_COUNTED, _NUMBERED)),
}

_NEWEST = "SELECT {0}, rule_id, method_id, title, description FROM (SELECT f.*, m.app_id, row_number() OVER (PARTITION BY m.app_id, f.rule_id ORDER BY f.method_id DESC, title, description) AS nth FROM found f JOIN methods m ON f.method_id = m.method_id) x WHERE nth <= 3"
_PROMPT = report.FIELD_IMPACT_PROMPT.replace("'", "''").split("{{")
_FILLED = "concat('" + _PROMPT[0] + "', " + ", ".join({"table": "concat('app ', app_id)", "columns": "'all'", "methods": "ids", "endpoints": "'none'", "findings": "rules"}[p.split("}}")[0]] + ", '" + p.split("}}")[1] + "'" for p in _PROMPT[1:]) + ")"
ORACLES |= {
    "findings_kept": _sql(_NEWEST.format("app_id"), _CYCLE, _TRAILS, _rendered()),
    "reports_kept": _sql(f"SELECT concat('app ', app_id) AS run, 'field_impact_analysis' AS name, {_FILLED} AS prompt FROM (SELECT m.app_id, string_agg(DISTINCT f.rule_id, ', ' ORDER BY f.rule_id) AS rules, array_to_string(list_sort(list(DISTINCT f.method_id)), ', ') AS ids FROM found f JOIN methods m ON f.method_id = m.method_id GROUP BY m.app_id) r", _CYCLE, _TRAILS, _rendered()),
    "findings_of_own_rule": _sql("""SELECT rule_id, severity, method_id, title, description FROM found WHERE rule_id IN ('orphan-code', 'layer-violation')
        UNION ALL SELECT 'many-writes', 'LOW', m.method_id, concat('Writes in ', class_name, '.', signature), concat('Writes ', n, ' tables.') FROM (SELECT method_id, count(DISTINCT table_id) AS n FROM accesses WHERE operation <> 'SELECT' GROUP BY method_id HAVING count(DISTINCT table_id) > 1) w JOIN methods m ON w.method_id = m.method_id""", _CYCLE, _TRAILS, _rendered()),
    "whole_neighbours": with_whole_views(ORACLES["neighbours"]),
    "whole_callers": with_whole_views(ORACLES["callers"]),
    "whole_method_accesses": with_whole_views(ORACLES["method_accesses"]),
    "whole_scan_stats": with_whole_views(_sql("""SELECT m.app_id, m.entries, m.methods, coalesce(c.n, 0) AS relations, coalesce(a.n, 0) AS sql_relations, coalesce(a.t, 0) AS tables FROM (SELECT app_id, count(*) FILTER (WHERE is_entry) AS entries, count(*) AS methods FROM methods GROUP BY app_id) m
        LEFT JOIN (SELECT app_id, count(*) AS n FROM calls JOIN methods ON src = method_id GROUP BY app_id) c ON m.app_id = c.app_id LEFT JOIN (SELECT o.app_id, count(*) AS n, count(DISTINCT table_id) AS t FROM accesses x JOIN methods o ON x.method_id = o.method_id GROUP BY o.app_id) a ON m.app_id = a.app_id""")),
}
