import random

import pytest

from sparkloom.operators import traverse


@pytest.mark.parametrize("n, calls, least, first", [(6, 14, 1, 25), (40, 60, 2, 10_000), (5, 0, 2, 50), (12, 40, 2, 50)])
def test_first_trails_are_those_of_the_whole_list(spark, n, calls, least, first):
    rng = random.Random(n)
    rows = spark.createDataFrame([(f"c{i}", rng.randrange(n), rng.randrange(n)) for i in range(calls)], "call_id string, src long, dst long")
    whole = traverse.closed_trails(rows, least, 4).orderBy("start", "depth", "cycle").limit(first).collect()
    assert sorted(map(tuple, traverse.first_trails(rows, least, 4, first).collect())) == sorted(map(tuple, whole))


def test_trails_of_later_starts_are_not_made(spark, monkeypatch):
    """All trails of all starts were made and sorted for the first of them."""
    asked, made = [], traverse._trails_between
    monkeypatch.setattr(traverse, "_trails_between", lambda hops, own, least, most: asked.append(own) or made(hops, own, least, most))
    rows = spark.createDataFrame([(f"{a}-{b}", a, b) for a in range(12) for b in range(12) if a != b], "call_id string, src long, dst long")
    assert [r["start"] for r in traverse.first_trails(rows, 2, 3, 20).collect()] == [0] * 20 and asked == ["start <= 3"]
