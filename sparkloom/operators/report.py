"""Reports, messages and latest-state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import facts

#: The prompt for a table; {{name}} stands for a value.
TABLE_PROMPT = """## Table {{table}}
Columns in use ({{n_columns}}): {{columns}}
Methods that access it: {{n_methods}}; strongest operation: {{operation}}
Columns without recent access: {{dead}}
Say what a change of this table would touch, and what could be removed."""


#: The prompts for columns that may go, and for what a change of columns touches.
DEAD_COLUMNS_PROMPT = """## Columns of {{table}} that may be unused
Columns: {{columns}}
Findings so far: {{findings}}
Name the columns that nobody reads, that carry an old name or that are only written, what removing each would risk, and which must stay for audits."""
FIELD_IMPACT_PROMPT = """## What a change of {{table}} touches
Columns: {{columns}}
Methods: {{methods}}
Endpoints above them: {{endpoints}}
Findings so far: {{findings}}
For each column say how many methods and endpoints a change would reach, how risky that is, and what to test before it."""
GOVERNANCE_PROMPT = """## Duties of {{table}}
Columns: {{columns}}
Methods: {{methods}}
Endpoints above them: {{endpoints}}
One way down to it: {{call_chain}}
Findings so far: {{findings}}
Say whether the table does too much, what could be split off, how far a change would reach, and which columns are open to too many."""

TEMPLATES = {"table": TABLE_PROMPT, "dead_column_analysis": DEAD_COLUMNS_PROMPT, "field_impact_analysis": FIELD_IMPACT_PROMPT, "table_governance": GOVERNANCE_PROMPT}
#: The prefix of topics.
TOPIC = "lineage."


def template(name: str) -> str:
    """A prompt by its name."""
    if name not in TEMPLATES:
        raise KeyError(f"no template {name}; there are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name]


def as_document(rows: DataFrame, key: str) -> DataFrame:
    """key, document: each row as an indented JSON text for a language model."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("document"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with every {{name}} replaced; all names that have no value are told at once."""
    parts = template.replace("}}", "{{").split("{{")
    missing = sorted({p for p in parts[1::2] if p not in values})
    if missing:
        raise KeyError("no value for " + ", ".join(missing))
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def table_prompts(state: DataFrame, as_of: Column, days: int) -> DataFrame:
    """table_name, prompt: what is known of each table, as one text."""
    known = state.where("column_name <> '*'").groupBy("table_name").agg(
        F.array_sort(F.collect_set("column_name")).alias("columns"), F.countDistinct("method_id").alias("n_methods"), facts.strongest(F.col("operation")).alias("operation")
    )
    dead = facts.dead_columns(state, as_of, days).groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ", ").alias("dead"))
    rows = known.join(dead, "table_name", "left")
    values = {"table": F.col("table_name"), "n_columns": F.size("columns"), "columns": F.array_join("columns", ", "), "n_methods": F.col("n_methods"), "operation": F.col("operation"), "dead": F.coalesce("dead", F.lit("none"))}
    return rows.select("table_name", fill(template("table"), values).alias("prompt"))


def named_prompts(name: str, rows: DataFrame) -> DataFrame:
    """table, name, prompt: a template filled from columns of its names, a prompt for each row; lists are joined by commas, nulls are empty."""
    kinds = dict(rows.dtypes)
    values = {c: F.array_join(c, ", ") if kinds[c].startswith("array") else F.col(c) for c in rows.columns}
    return rows.select("table", F.lit(name).alias("name"), fill(template(name), values).alias("prompt"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by the given columns; tasks keep one row a key before anything is shuffled."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("last")).select("last.*")


def as_messages(rows: DataFrame, key: str, first: str, topic: str = "lineage.access") -> DataFrame:
    """topic, key, value: rows as keyed JSON messages, ready for a message sink."""
    columns = [first, *(c for c in rows.columns if c != first)]
    return rows.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def event_messages(events: DataFrame) -> DataFrame:
    """topic, key, value of the events of scans (trace, event_id, ts, event, ...): a topic for each class of event, keyed by trace; events without a class are none."""
    columns = ["trace", "event_id", *(c for c in events.columns if c not in ("trace", "event_id", "event"))]
    return events.where("event IS NOT NULL").select(F.concat(F.lit(TOPIC), "event").alias("topic"), F.col("trace").alias("key"), F.to_json(F.struct(*columns)).alias("value"))
