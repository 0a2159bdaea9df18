"""Every registered query of the engine, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import fact_queries, graph_queries, listing_queries, resolve_queries, rule_queries, source_queries, stream_queries, text_queries

MODULES = [fact_queries, graph_queries, listing_queries, resolve_queries, rule_queries, source_queries, stream_queries, text_queries]

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
