"""Every query that SQL expresses gives DuckDB's rows on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, str(FOLDER))
    got = rows_of(frame.collect(), frame.columns)
    asked = duck.execute(ORACLES[name])
    columns = [c[0] for c in asked.description]
    assert got == rows_of(asked.fetchall(), columns)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(registry.queries())
