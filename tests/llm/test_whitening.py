import math

import numpy as np
import pytest

from sparkloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component int, whitened double, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0, 4) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k):
    """n, per row deviation, projections (up to sign), eigenvalues and trace by numpy's own eigenvectors."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    centred = (x * n - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(k, int((values > 1e-12 * values[0]).sum()))
    return n, deviation, np.abs(centred @ vectors[:, :keep] / np.sqrt(values[:keep])), values, values.sum()


def check(spark, rows, k=32):
    got = whitening.whitened(frame(spark, rows), k).collect()
    n, deviation, white, values, trace = brute(rows, k)
    keep = white.shape[1]
    assert len(got) == n * keep
    ids = [i for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = sorted((str(i), j + 1, d, round(w[j], 5)) for i, d, w in zip(ids, deviation, white, strict=True) for j in range(keep))
    have = sorted((str(r["vec_id"]), r["component"], r["deviation"], round(abs(r["whitened"]), 5)) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 2e-5
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-6
        assert abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-8
    signs = {}
    for r in got:  # columns are whole components, of one sign for all rows
        signs.setdefault(r["component"], []).append(r["whitened"])
    assert all(abs(np.square(v).mean() - 1) < 1e-6 and abs(np.mean(v)) < 1e-6 for v in signs.values())


def test_equals_numpy(spark):
    rng = np.random.default_rng(2)
    scale = np.exp(rng.normal(0, 1, 40))
    rows = [(i, (rng.normal(0, 1, 40) * scale).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (900, None), (901, [1.0, None]), (902, [math.nan] * 40), (903, [math.inf] * 40), (904, []), (905, [2.0] * 12), (None, rows[3][1])]
    check(spark, rows)


def test_fewer_directions_and_none(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, float(i % 3)]) for i in range(20)]
    check(spark, rows)
    same = frame(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert whitening.whitened(same).count() == 0 == whitening.whitened(same.where("false")).count()
    assert whitening.whitened(frame(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_components(spark):
    """Deviations near the bound of a long are exact, those beyond it are null."""
    rows = [(i, [60_000.0 * i, float(i * i)]) for i in range(30)]
    check(spark, rows, 2)
    got = whitening.whitened(frame(spark, [(1, [1e30, 1.0]), (2, [-1e30, 0.5]), (3, [0.0, 0.0])])).collect()
    assert {r["deviation"] for r in got if r["vec_id"] < 3} == {None}


def test_many_dimensions_are_refused(spark):
    with pytest.raises(ValueError, match="components"):
        whitening.whitened(frame(spark, [(1, [0.5] * (whitening.MOST_DIMS + 5))]))


@pytest.mark.parametrize("kind", ["random", "close", "equal", "split", "rank", "one", "two"])
def test_eigenvectors(kind):
    """Residuals and angles to double precision, for clusters, equal values, split and short-ranked matrices."""
    rng = np.random.default_rng(5)
    n = {"one": 1, "two": 2}.get(kind, 60)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {"close": 10 + 1e-9 * np.arange(n), "equal": np.repeat([9.0, 4.0, 1.0], 20), "rank": np.concatenate([np.arange(1, 11.0), np.zeros(50)])}.get(kind, np.arange(1.0, n + 1) ** 2)
    a = np.diag(values) if kind == "split" else (q * values) @ q.T
    a = (a + a.T) / 2
    k = min(n, 32)
    got, vectors = whitening.leading_vectors(a, k)
    size = np.abs(values).max()
    assert np.abs(got - np.sort(values)[::-1][:k]).max() < 1e-12 * size
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * size and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.normal(size=20), rng.normal(size=19)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 41)
    assert (whitening.counts_below(d, e, at) == (values[None, :] < at[:, None]).sum(axis=1)).all()
    assert np.abs(whitening.leading_values(d, e, 7) - values[::-1][:7]).max() < 1e-14 * 20
