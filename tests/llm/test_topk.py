import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score long"


def brute(rows, is_query, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole}):
        if is_query(q):
            a = min(v for i, v in whole if i == q)
            best = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in whole if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    """Ties, repeated rows, vectors of other lengths, odd components; at once, and with a first look and several blocks."""
    if small:
        monkeypatch.setattr(topk, "FIRST_LOOK", 60)
        monkeypatch.setattr(topk, "BLOCK_BYTES", 600)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(50, rows[50][1]), (7, rows[7][1]), (100, [0.1] * 16)]
    rows += [(500, None), (501, []), (502, [math.nan] * 16), (503, [math.inf] * 16), (504, [None] * 16), (505, [0.5] * 8), (550, [0.25] * 40), (600, []), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 10)


def test_few_rows_and_empty(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(5)]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") < 2, 3).collect()) == brute(rows, lambda i: i < 2, 3)
    assert sorted(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") < 2, 30).collect()) == brute(rows, lambda i: i < 2, 30)
    empty = frame.where("false")
    assert topk.exact_top_k(empty, F.col("vec_id") < 2).count() == 0 == topk.exact_top_k(frame, F.col("vec_id") > 90).count()


def test_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 20_000 if i % 2 else 3).tolist()) for i in range(12)]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, rank int, score long")
    assert sorted(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") < 3, 4).collect()) == brute(rows, lambda i: i < 3, 4)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-500, 500, (20, 30)), rng.integers(-500, 500, (20, 30))
    last = None
    for s in topk.resolutions(30):
        bound = topk.features(a, s) @ topk.features(b, s).T
        assert (bound >= a @ b.T - 1e-6).all()
        assert last is None or bound.sum() <= last
        last = bound.sum()
