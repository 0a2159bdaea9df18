"""Analysis rules: each takes a graph and returns one row per finding; `findings` renders them all alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.fixture import Graph
from sparkloom.operators import traverse


def god_method(graph: Graph, least: int = 5) -> DataFrame:
    """Methods that access at least `least` distinct tables, with the tables as a sorted string."""
    touched = graph.accesses.groupBy("method_id").agg(F.collect_set("table_id").alias("tables")).where(F.size("tables") >= least)
    return touched.join(graph.methods, "method_id").select("method_id", "signature", "class_name", F.array_join(F.transform(F.sort_array("tables"), lambda t: t.cast("string")), ",").alias("tables"), F.size("tables").cast("long").alias("n_tables"))


def n_plus_one(graph: Graph, most: int = 3) -> DataFrame:
    """Accesses of methods that lie on a call cycle of at most `most` calls."""
    looping = traverse.on_cycle(graph.calls, most)
    hits = graph.accesses.join(looping, "method_id", "left_semi")
    return hits.join(graph.methods, "method_id").select("method_id", "signature", "class_name", "table_id", "operation")


def circular_dep(graph: Graph, least: int = 2, most: int = 5, first: int | None = None) -> DataFrame:
    """Closed trails of `least` to `most` calls, one row for each start, with the methods on the way; all, or the `first` so many by start, length and way."""
    found = traverse.closed_trails(graph.calls, least, most) if first is None else traverse.first_trails(graph.calls, least, most, first)
    return found.join(graph.methods, F.col("start") == F.col("method_id")).select("method_id", "signature", "class_name", "cycle", "depth")


def orphan_code(graph: Graph) -> DataFrame:
    """Methods that nothing calls (a call of itself counts) and that are no entries."""
    called = graph.calls.select(F.col("dst").alias("method_id")).distinct()
    return graph.methods.where("NOT is_entry").join(called, "method_id", "left_anti").select("method_id", "signature", "class_name")


def many_writes(graph: Graph) -> DataFrame:
    """Methods that write more than one table, with their number; no rule of its own, one to register."""
    written = graph.accesses.where("operation <> 'SELECT'").groupBy("method_id").agg(F.countDistinct("table_id").alias("n_tables")).where("n_tables > 1")
    return written.join(graph.methods, "method_id").select("method_id", "signature", "class_name", "n_tables")


def layer_violation(graph: Graph) -> DataFrame:
    """Accesses of entry methods in classes named Controller."""
    entries = graph.methods.where(F.col("is_entry") & F.col("class_name").contains("Controller"))
    return entries.join(graph.accesses, "method_id").select("method_id", "signature", "class_name", "table_id", "operation")


@dataclass(frozen=True)
class Rule:
    """A rule: how it is named and rendered, and how its rows are found."""

    id: str
    severity: str
    category: str
    rows: Callable[[Graph], DataFrame]
    title: str
    description: str
    suggestion: str


# Ids, severities, categories and the wording of findings. {column} stands for a column of the rule's rows.
RULES = [
    Rule("circular-dep", "HIGH", "architecture", circular_dep, "Circular dependency involving {class_name}.{signature}", "Cycle detected (depth {depth}): {cycle}", "Break the cycle by extracting shared logic into a separate class or using an event-driven approach."),
    Rule("god-method", "MEDIUM", "architecture", god_method, "God method: {class_name}.{signature}", "Method accesses {n_tables} tables ({tables}). Consider splitting into focused methods, one per aggregate.", "Extract table-specific logic into separate service methods."),
    Rule("layer-violation", "MEDIUM", "architecture", layer_violation, "Layer violation: {class_name}.{signature}", "Controller directly accesses table {table_id}. Should go through Service → Repository layers.", "Move DB access to a Repository, inject it into a Service, and call the Service from the Controller."),
    Rule("n-plus-one", "HIGH", "performance", n_plus_one, "N+1 risk: {class_name}.{signature}", "Method accesses {table_id} inside a self-calling loop. Each iteration may issue a separate query.", "Replace per-iteration {operation} with batch operation (e.g. MyBatis-Plus selectBatchIds or collecting IDs first)."),
    Rule("orphan-code", "LOW", "dead_code", orphan_code, "Orphan method: {class_name}.{signature}", "Method has no callers and is not an entry point.", "Verify if this method is still needed. If dead code, remove it. If it should be reachable, ensure it's wired into a call chain."),
]


def render(template: str) -> Column:
    """A template's text, {column} replaced by the column."""
    parts = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.col(part).cast("string") if i % 2 else F.lit(part))
    return F.concat(*parts)


def register(rule: Rule) -> None:
    """Add a rule to those that `findings` runs, in order of id; one of the same id is replaced."""
    RULES[:] = sorted([r for r in RULES if r.id != rule.id] + [rule], key=lambda r: r.id)


def findings(graph: Graph, ids: list[str] | None = None, app: int | None = None, own: list[Rule] | None = None) -> DataFrame:
    """Findings of the named rules (all by default) on methods of `app` (all by default), in order of rule id; unknown ids give none. `own` rules stand beside those that are registered."""
    chosen = [r for r in sorted(RULES + (own or []), key=lambda r: r.id) if ids is None or r.id in ids]
    out = None
    for rule in chosen:
        rows = rule.rows(graph)
        one = rows.select(
            F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"), "method_id",
            render(rule.title).alias("title"), render(rule.description).alias("description"), render(rule.suggestion).alias("suggestion"), F.to_json(F.struct(*rows.columns)).alias("evidence"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        return graph.methods.sparkSession.createDataFrame([], "rule_id string, severity string, category string, method_id long, title string, description string, suggestion string, evidence string")
    return out if app is None else out.join(graph.methods.where(F.col("app_id") == app).select("method_id"), "method_id", "left_semi").select(out.columns)


def digest(found: DataFrame, latest: int = 50, shown: int = 15) -> DataFrame:
    """One row: the first `shown` of the `latest` findings, a line each. found: created (orders the findings), severity, title."""
    top = found.where(F.col("title").isNotNull()).orderBy(F.desc("created"), "title").limit(latest)
    ranked = top.orderBy(F.desc("created"), "title").limit(shown)
    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("title"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("created")).alias("o"), F.col("title").alias("t"), line.alias("line"))))
    return ranked.agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("digest"), F.count("*").alias("n"))
