import random

import pytest

from sparkloom.operators import bitreach, traverse
from tests.test_traverse import distances, graph_of


def wanted(calls, methods, starts, most, first):
    known, up, out = {m[0]: m for m in methods}, [(c[0], c[2], c[1]) for c in calls], []
    for s in starts:
        found = sorted((n, d) for n, d in distances(up, s).items() if 0 < d <= most and n in known and s in known and known[n][2] and known[n][1] == known[s][1])
        out += [(s, n, d) for n, d in found[:first]]
    return sorted(out)


def rows(found):
    return sorted(tuple(r) for r in found.collect())


def test_entries_that_reach_all_starts_are_few(spark, monkeypatch):
    """All starts were followed up to all entries, whose pairs grow with the square of the methods."""
    monkeypatch.setattr(traverse, "ENTRIES_FIRST", 8)
    rng, followed, numbered = random.Random(3), [], bitreach.numbered
    monkeypatch.setattr(bitreach, "numbered", lambda seeds: followed.append(seeds.count()) or numbered(seeds))
    methods = [(m, m % 2, True, "C", f"m{m}()") for m in range(120)]
    calls = [(f"c{i}", i % 120, rng.randrange(120)) for i in range(1200)]
    g = graph_of(spark, calls, (), methods)
    got = rows(traverse.upstream_entries(g, g.methods.select("method_id"), 6, 4))
    assert got == wanted(calls, methods, range(120), 6, 4) and sum(followed) <= 16


@pytest.mark.parametrize("first, more, many", [(1, 2, 40), (2, 8, 90), (64, 8, 200)])
def test_rounds_of_entries_equal_walks_of_each_start(spark, monkeypatch, first, more, many):
    monkeypatch.setattr(traverse, "ENTRIES_FIRST", first)
    monkeypatch.setattr(traverse, "ENTRIES_MORE", more)
    rng = random.Random(many)
    calls = [(f"c{i}", rng.randrange(40), rng.randrange(40)) for i in range(many)] + [("x", 70, 71)]
    calls += [(f"y{i}", 200, 201) for i in range(400)]  # the mean number of calls alone makes the first round small
    methods = [(m, m % 3 if m % 10 else None, m % 2 == 1, "C", f"m{m}()") for m in [*range(40), 70, 71]]
    g = graph_of(spark, calls, (), methods)
    starts = spark.createDataFrame([(s,) for s in [*range(0, 40, 2), 71, 99]] * 2, "method_id long")
    known = [m for m in methods if m[1] is not None]
    assert rows(traverse.upstream_entries(g, starts, 3, 3)) == wanted(calls, known, [*range(0, 40, 2), 71, 99], 3, 3)
