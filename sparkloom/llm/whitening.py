"""Whitening of embeddings by the leading eigenvectors of their covariance.

Components are taken as whole numbers x = floor(64 * c) + 1000000. A first scan sums them exactly, a second sums the
products of components less their means, each task its own, and the tasks' sums meet by rows of the matrix. That matrix,
of a bounded number of dimensions, is made tridiagonal by Householder reflections; bisection by Sturm counts finds its
largest eigenvalues, and inverse iteration their vectors, made orthogonal to each other within clusters of close
eigenvalues. The projection is broadcast, and vectors are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are held within +-LARGEST before they are scaled.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 39)
#: Dimensions whose covariance the driver holds (8 bytes a pair, a few copies).
MOST_DIMS = 2048
#: Numbers of a task's matrix at once.
AT_ONCE = 1 << 20
#: Eigenvalues closer than this share of the largest are one cluster, and ones below RANK of it are none.
CLUSTER, RANK = 1e-3, 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double"


@dataclass
class Whitening:
    """n vectors of exact sums; means; unit eigenvectors as columns; their eigenvalues, falling; the covariance's trace."""

    n: int
    sums: list[int]
    means: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections' unit vectors (of the last rows each) of a symmetric matrix."""
    a, turns = matrix.astype(float).copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= v * (v @ w)
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each number: the negative terms of its Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    square = np.concatenate([[0.0], off**2])
    found, q = np.zeros(len(at), int), np.ones(len(at))
    for d, e in zip(diagonal, square, strict=True):
        q = d - at - e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        found += q < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to neighbouring floating-point numbers."""
    n, radius = len(diagonal), np.zeros(len(diagonal))
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    reach = np.finfo(float).eps * np.abs(np.concatenate([diagonal, off])).max() * n
    low, high = np.full(k, (diagonal - radius).min() - reach), np.full(k, (diagonal + radius).max() + reach)
    rank = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        below = counts_below(diagonal, off, middle) > rank
        high, low = np.where(below, middle, high), np.where(below, low, middle)


def solved(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each number, the solution of (matrix - number) x = its column of `right`, by elimination with row exchanges."""
    n, k = right.shape
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    u0, u1, u2, b = np.empty((n, k)), np.zeros((n, k)), np.zeros((n, k)), right.copy()
    head, after = diagonal[0] - at, np.full(k, off[0] if n > 1 else 0.0)
    for i in range(n - 1):
        low, middle, last = np.full(k, off[i]), diagonal[i + 1] - at, np.full(k, off[i + 1] if i + 2 < n else 0.0)
        swap = np.abs(low) > np.abs(head)
        u0[i], u1[i], u2[i] = np.where(swap, low, head), np.where(swap, middle, after), np.where(swap, last, 0.0)
        u0[i] = np.where(np.abs(u0[i]) < tiny, tiny, u0[i])
        factor = np.where(swap, head, low) / u0[i]
        top, bottom = np.where(swap, b[i + 1], b[i]), np.where(swap, b[i], b[i + 1])
        b[i], b[i + 1] = top, bottom - factor * top
        head, after = np.where(swap, after, middle) - factor * u1[i], np.where(swap, 0.0, last) - factor * u2[i]
    u0[-1] = np.where(np.abs(head) < tiny, tiny, head)
    for i in range(n - 1, -1, -1):
        for step, u in ((1, u1), (2, u2)):
            if i + step < n:
                b[i] -= u[i] * b[i + step]
        b[i] /= u0[i]
    return b


def leading_vectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    diagonal, off, turns = tridiagonal(matrix)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    if not size:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off = diagonal / size, off / size
    values = leading_values(diagonal, off, k)
    clusters = np.concatenate([[0], np.cumsum(values[:-1] - values[1:] > CLUSTER * np.abs(values[0]))])
    apart = values - np.finfo(float).eps * 4 * np.arange(k)  # equal values get slightly different systems
    x = np.random.default_rng(0).normal(size=(len(matrix), k))
    for _ in range(4):
        x = solved(diagonal, off, apart, x / np.abs(x).max(axis=0))
        x /= np.linalg.norm(x, axis=0)
        for c in range(clusters[-1] + 1):
            mine = np.flatnonzero(clusters == c)
            for i, at in enumerate(mine):
                for _ in range(2):  # twice is enough
                    x[:, at] -= x[:, mine[:i]] @ (x[:, mine[:i]].T @ x[:, at])
                    x[:, at] /= np.linalg.norm(x[:, at])
    for i in range(len(turns) - 1, -1, -1):
        x[i + 1 :] -= 2 * np.outer(turns[i], turns[i] @ x[i + 1 :])
    x /= np.linalg.norm(x, axis=0)
    values = np.einsum("ij,ij->j", x, matrix @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double): rows whose vector is not null and holds only finite numbers."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(64 * c) as rows of `dims` whole numbers, without the offset; missing components of shorter vectors count as c = 0."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    inside = np.arange(dims)[None, :] < sizes[:, None]
    out[inside] = np.floor(SCALE * np.clip(values[offsets[0] : offsets[-1]], -LARGEST, LARGEST)).astype(np.int64)
    return out


def _parts(batches: Iterator[pa.RecordBatch], dims: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            sizes = np.diff(batch.column(1).offsets.to_numpy()[low:])
            most = np.maximum.accumulate(sizes) * np.arange(1, len(sizes) + 1)
            some = batch.slice(low, max(1, int((most <= AT_ONCE).sum())))
            low += some.num_rows
            yield some.column(0), whole(some.column(1), dims if dims is not None else int(sizes[: some.num_rows].max(initial=0)))


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension, offset included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * 0
        for _, x in _parts(batches):
            n += len(x)
            total += [0] * (x.shape[1] - len(total))
            for i, s in enumerate(x.sum(axis=0).tolist()):
                total[i] += s
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([Decimal(s) for s in [n, *total]], pa.decimal128(38, 0))], names=["at", "total"])

    rows = vectors.mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    found = {r["at"]: int(r["total"]) for r in rows.limit(MOST_DIMS + 2).collect()}
    if len(found) > MOST_DIMS + 1:
        raise ValueError(f"vectors of more than {MOST_DIMS} components")
    n = found.get(-1, 0)
    return n, [found[i] + n * OFFSET for i in range(len(found) - 1)]


def products(vectors: DataFrame, means: np.ndarray, projection: np.ndarray | None = None) -> np.ndarray:
    """Sums over all vectors of the products of each two centred components; with a projection, of those of the projected vectors, and a last row of their sums."""
    shared, dims = vectors.sparkSession.sparkContext.broadcast((means, projection)), len(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, projection = shared.value
        total = None
        for _, x in _parts(batches, dims):
            d = x - (means - OFFSET)
            if projection is not None:
                d = np.column_stack([d @ projection, np.ones(len(d))])
            total = d.T @ d if total is None else total + d.T @ d
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "row"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "row": [np.sum(np.stack(group["row"].to_list()), axis=0)]})

    rows = vectors.mapInArrow(run, "at int, row array<double>").groupBy("at").applyInPandas(add, "at int, row array<double>").collect()  # MOST_DIMS at most
    return np.array([r["row"] for r in sorted(rows)])


def fit(vectors: DataFrame, k: int = 32) -> Whitening:
    """The whitening by up to k leading components of all `vectors` (as of finite_vectors); eigenvalues that round-off could make are none."""
    n, sums = exact_sums(vectors)
    means = np.array([OFFSET + (s - n * OFFSET) / n for s in sums]) if n else np.zeros(0)
    if not n or not len(sums):
        return Whitening(n, sums, means, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    covariance = products(vectors, means) / n
    covariance = (covariance + covariance.T) / 2
    values, found = leading_vectors(covariance, min(k, len(sums)))
    real = values > RANK * max(values[0], 0)
    return Whitening(n, sums, means, found[:, real], values[real], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance, over all of them, less the identity."""
    if not len(model.values):
        return 0.0
    total = products(vectors, model.means, model.projection) / model.n
    mean = total[-1, :-1]
    return float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """OUT: a row for each vector and component.

    deviation is the sum over dimensions of (n * x - sum)^2, exact; null where it is beyond a long.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k, n, projection = len(model.values), model.n, model.projection
        totals = [s - n * OFFSET for s in model.sums]
        for ids, x in _parts(batches, len(model.sums)):
            largest = float(n) * max(1.0, float(np.abs(x).max(initial=0))) + max(map(abs, totals), default=0)
            kind = np.int64 if largest**2 * max(1, x.shape[1]) < 2**62 else object  # Python's whole numbers have no bound
            off = n * x.astype(kind) - np.array(totals, kind)
            deviation = [s if s < 2**63 else None for s in (off * off).sum(axis=1).tolist()]
            white = (x - (model.means - OFFSET)) @ projection
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(len(ids)), k))),
                    pa.array(np.tile(np.arange(1, k + 1), len(ids)), pa.int32()),
                    pa.array(np.full(len(ids) * k, n), pa.int64()),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened"],
            )

    return vectors.mapInArrow(run, OUT)


def whitened(vectors: DataFrame, k: int = 32) -> DataFrame:
    """OUT, and explained (the eigenvalue's share of the trace) and identity_error (one value).

    vectors: vec_id, embedding. Rows whose vector is null or holds null or non-finite components go; a null vec_id stays.
    Repeated rows count each. The longest vector gives the number of dimensions (MOST_DIMS at most, more are an error);
    shorter and empty vectors are filled up with 0. Components beyond +-LARGEST count as that. Where the vectors span
    fewer than k directions there are fewer components, and none where all are equal, so no rows. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    rows = finite_vectors(vectors)
    model = fit(rows, k)
    error = identity_error(rows, model)
    shares = F.lit((model.values / model.trace).tolist() if model.trace else []).cast("array<double>")
    return whiten(rows, model).withColumns({"explained": F.get(shares, F.col("component") - 1), "identity_error": F.lit(error)})
