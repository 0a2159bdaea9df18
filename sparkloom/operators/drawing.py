"""Traces through the resolver of external calls, as nodes, edges and groups for drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.fixture import Graph
from sparkloom.operators import resolve
from sparkloom.scratch import saved

# How methods, entries, methods of other apps, calls without a known target, tables and calls are drawn.
METHOD_FILL, ENTRY_FILL = "#91d5ff", "#1890ff"
FOREIGN = {"fill": "#fa8c16", "stroke": "#d46b08"}
UNRESOLVED = {"fill": "#ddd", "stroke": "#999", "strokeDasharray": "5,5"}
ACCESS = {"stroke": "#52c41a"}
INTERNAL_STROKE, EXTERNAL_STROKE, DASHES = "#666", "#fa8c16", [8, 4]


def through_resolver(graph: Graph, texts: DataFrame, methods: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph whose external calls lead where their expression says, and the resolved ones (call_id, dst, protocol, expression).

    texts: call_id, src, call_type, expression; methods as in resolve_external(). An external call without a known target
    has no dst, so that no trace follows it.
    """
    outside = texts.where("call_type = 'EXTERNAL'")
    found = saved(resolve.resolve_external(outside, methods).join(outside.select("call_id", "expression"), "call_id"))
    internal = graph.calls.where("call_type = 'INTERNAL'")
    external = graph.calls.where("call_type = 'EXTERNAL'").drop("dst").join(found.select("call_id", "dst"), "call_id", "left")
    return Graph(graph.methods, internal.unionByName(external.select(internal.columns)), graph.accesses), found


def _styled(values: dict) -> Column:
    return F.struct(*((F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in values.items()))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def draw(graph: Graph, visits: DataFrame, followed: DataFrame, found: DataFrame, view: str = "class") -> DataFrame:
    """seed, part (node, edge or combo), kind, json: everything that a trace shows, each node, edge and combo once a seed.

    view: `class` and `service` show groups, every other one (`method`) has nodes and edges alone. Methods may have
    package_name, return_type, http_path and line_number too; those that they lack are empty.

    followed: seed, call_id of the calls into other apps that the trace went along; other external calls of visited
    methods, unresolved or beyond the cap on hops, end in a placeholder.
    """
    known = visits.join(graph.methods, F.col("node") == F.col("method_id"))
    label = F.concat_ws(".", "class_name", "signature")
    field = lambda name: F.coalesce(_text(name), F.lit("")) if name in graph.methods.columns else F.lit("")
    line = F.coalesce(F.col("line_number"), F.lit(0)) if "line_number" in graph.methods.columns else F.lit(0)
    data = F.struct("signature", field("return_type").alias("returnType"), F.coalesce(_text("app_id"), F.lit("")).alias("appId"), field("http_path").alias("httpPath"), line.alias("lineNumber"))
    owner = F.concat_ws(".", F.when(field("package_name") != "", field("package_name")), "class_name")
    combo = F.coalesce(F.concat(F.lit("app:"), _text("app_id")), owner)
    fill = F.struct(F.when(F.col("is_entry"), ENTRY_FILL).otherwise(METHOD_FILL).alias("fill"))

    def row(rows: DataFrame, part: str, kind: str, **fields: Column) -> DataFrame:
        return rows.select("seed", F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("json"))

    nodes = row(known, "node", "METHOD", id=_text("method_id"), type=F.lit("METHOD"), label=label, comboId=combo, data=data, style=fill)
    hits = visits.join(graph.accesses, F.col("node") == F.col("method_id"))
    table = F.concat(F.lit("table:"), _text("table_id"))
    tables = row(hits, "node", "TABLE", id=table, type=F.lit("TABLE"), label=table, data=F.struct("operation"))
    uses = row(hits, "edge", "ACCESSES", source=_text("method_id"), target=table, type=F.lit("ACCESSES"), style=_styled(ACCESS))
    calls = visits.join(graph.calls, F.col("node") == F.col("src")).join(followed.withColumn("went", F.lit(True)), ["seed", "call_id"], "left")
    calls = saved(calls.select("seed", "call_id", "src", "dst", "call_type", "went"))  # edges and placeholders are made of it
    outside = F.col("call_type") == "EXTERNAL"
    target = F.coalesce(F.when(~outside | F.col("went"), _text("dst")), F.concat(F.lit("call:"), "call_id"))
    stroke = F.when(outside, _styled({"stroke": EXTERNAL_STROKE, "lineWidth": 2, "strokeDasharray": DASHES})).otherwise(F.struct(F.lit(INTERNAL_STROKE).alias("stroke"), F.lit(1).alias("lineWidth"), F.lit(None).cast("array<int>").alias("strokeDasharray")))
    edges = row(calls, "edge", "CALLS", id=F.col("call_id"), source=_text("src"), target=target, type=F.lit("CALLS"), subType=F.col("call_type"), style=stroke)
    holders = row(calls.where(outside & F.col("went").isNull()), "node", "METHOD", id=target, type=F.lit("METHOD"), label=F.concat(F.lit("unresolved:"), target), data=F.struct(F.lit(True).alias("unresolved")), style=_styled(UNRESOLVED))
    reached = followed.join(found, "call_id").join(graph.methods, F.col("dst") == F.col("method_id"))
    said = F.concat(F.lit("["), _text("app_id"), F.lit("] "), label)
    foreign = row(reached, "node", "METHOD", id=_text("method_id"), type=F.lit("METHOD"), label=said, comboId=combo, data=F.struct(F.col("app_id").cast("string").alias("appId"), "protocol", F.col("expression").alias("resolvedFrom")), style=_styled(FOREIGN))
    classes = row(known, "combo", "CLASS", id=owner, type=F.lit("CLASS"), label=F.col("class_name"), collapsed=F.lit(False))
    apps = row(reached, "combo", "APP", id=combo, type=F.lit("APP"), label=_text("app_id"), collapsed=F.lit(False))
    out = nodes
    for more in (tables, uses, edges, holders, foreign, *([classes, apps] if view in ("class", "service") else [])):
        out = out.unionByName(more)
    return out.distinct()


def raw(drawn: DataFrame, paths: DataFrame) -> DataFrame:
    """seed, methods, tables, calls, accesses, paths: what was drawn by kind, each a JSON array in order of its texts."""

    def listed(part: str, kind: str, name: str) -> Column:
        texts = F.sort_array(F.collect_list(F.when((F.col("part") == part) & (F.col("kind") == kind), F.col("json"))))
        return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias(name)

    by = drawn.groupBy("seed").agg(listed("node", "METHOD", "methods"), listed("node", "TABLE", "tables"), listed("edge", "CALLS", "calls"), listed("edge", "ACCESSES", "accesses"))
    ways = paths.groupBy("seed").agg(F.to_json(F.sort_array(F.collect_list("path"))).alias("paths"))
    return by.join(ways, "seed", "left").withColumn("paths", F.coalesce("paths", F.lit("[]")))
