"""The flagship query: methods that touch many tables."""

from __future__ import annotations

from sparkloom.fixture import graph
from sparkloom.operators import rules
from sparkloom.plans.graph_queries import GOD_METHOD

QUERIES = {"god_method": lambda spark, folder: rules.god_method(graph(spark, folder))}

ORACLES = {"god_method": GOD_METHOD}
