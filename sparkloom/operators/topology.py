"""Counts and labels over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(graph) -> DataFrame:
    """Every method with its distinct outgoing and incoming calls."""
    out = graph.calls.groupBy(F.col("src").alias("method_id")).agg(F.countDistinct("call_id").alias("out_deg"))
    into = graph.calls.groupBy(F.col("dst").alias("method_id")).agg(F.countDistinct("call_id").alias("in_deg"))
    joined = graph.methods.join(out, "method_id", "left").join(into, "method_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("out_deg", "in_deg")})


def value_labels(graph, threshold: int = 5, app: int | None = None, most: int = 100) -> DataFrame:
    """HIGH_IMPACT, DEPRECATED_SUSPECT and CRITICAL_PATH methods, at most `most` of each: highest score first, then by id."""
    known = degrees(graph)
    if app is not None:
        known = known.where(F.col("app_id") == app)
    total = F.col("out_deg") + F.col("in_deg")
    reason = F.concat(F.lit("out="), F.col("out_deg"), F.lit(" in="), F.col("in_deg"))

    def top(label: str, rows: DataFrame, score, why) -> DataFrame:
        return rows.select("method_id", "signature", "class_name", F.lit(label).alias("label"), score.alias("score"), why.alias("reason")).orderBy(F.desc("score"), "method_id").limit(most)

    high = top("HIGH_IMPACT", known.where(total > threshold), total, reason)
    idle = top("DEPRECATED_SUSPECT", known.where((total == 0) & ~F.col("is_entry")), F.lit(0).cast("long"), F.lit("no callers or callees"))
    busy = top("CRITICAL_PATH", known.where("out_deg >= 3 AND in_deg >= 3"), total, reason)
    return high.unionByName(idle).unionByName(busy)


def labels_grouped(labels: DataFrame) -> DataFrame:
    """Methods by label, as one sorted string and a count."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("method_id")), lambda i: i.cast("string")), ",")
    return labels.groupBy("label").agg(ids.alias("methods"), F.count("*").alias("n"))


def topology(graph) -> DataFrame:
    """Pairs of apps with external calls between them, their count and the line width min(5, 1 + count / 5)."""
    app = lambda side: graph.methods.select(F.col("method_id").alias(side), F.col("app_id").alias(f"{side}_app"))
    between = graph.calls.where("call_type = 'EXTERNAL'").join(app("src"), "src").join(app("dst"), "dst").where("src_app <> dst_app")
    return between.groupBy("src_app", "dst_app").agg(F.count("*").alias("n_calls")).withColumn("line_width", F.least(F.lit(5), 1 + F.floor(F.col("n_calls") / 5)).cast("int"))


def methods_per_app(graph) -> DataFrame:
    """Methods by app, the most first."""
    return graph.methods.groupBy("app_id").agg(F.count("*").alias("n_methods")).orderBy(F.desc("n_methods"), "app_id")


def scan_stats(graph) -> DataFrame:
    """app_id, entries, methods, relations, sql_relations, tables: what a scan of each app has found."""
    apps = graph.methods.groupBy("app_id").agg(F.count_if("is_entry").alias("entries"), F.count("*").alias("methods"))
    owner = graph.methods.select("method_id", "app_id")
    calls = graph.calls.join(owner, F.col("src") == F.col("method_id")).groupBy("app_id").agg(F.count("*").alias("relations"))
    uses = graph.accesses.join(owner, "method_id").groupBy("app_id").agg(F.count("*").alias("sql_relations"), F.countDistinct("table_id").alias("tables"))
    counts = ["relations", "sql_relations", "tables"]
    return apps.join(calls, "app_id", "left").join(uses, "app_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def graph_counts(graph) -> DataFrame:
    """One row per kind of element."""
    one = lambda kind, rows: rows.agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return one("methods", graph.methods).unionByName(one("calls", graph.calls)).unionByName(one("accesses", graph.accesses)).unionByName(one("tables", graph.accesses.select("table_id").distinct()))
