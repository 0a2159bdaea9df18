"""Exact top-k inner-product search with segment statistics at several resolutions.

For a vector cut to segments of equal length, <q, v> <= sum over segments of length * mean_q * mean_v + spread_q *
spread_v, where spread is the norm of what is left without the mean (the standard deviation times the root of the
length). In terms of distance, |q - v|^2 = |q|^2 + |v|^2 - 2 <q, v>, this is the usual lower bound. Bounds are computed
from one segment to ever more; only candidates whose bound reaches the k-th best exact score so far go on.

Queries are taken in blocks of a bounded size. A block is broadcast and all candidates are scanned where they lie; no
candidate is shuffled. A first scan over a share of the candidates gives each query a k-th best score that all tasks
of the whole scan begin with; a task then keeps the k best of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import saved

#: Bytes of the queries of a block (8 a component), and candidates of the first look, about.
BLOCK_BYTES, FIRST_LOOK = 1 << 25, 4096
#: Queries and components of candidates that are compared at once; they bound a task's memory.
QUERIES_AT_ONCE, COMPONENTS_AT_ONCE = 256, 1 << 20
OUT = "query_id long, vec_id long, score long"
NONE = -(2**63)


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the bounds at this resolution; the last segment may be shorter."""
    cuts = np.array_split(np.arange(x.shape[1]), segments)
    out = np.empty((len(x), 2 * len(cuts)))
    for i, cut in enumerate(cuts):
        part = x[:, cut].astype(float)
        mean = part.mean(axis=1) if len(cut) else np.zeros(len(x))
        out[:, 2 * i] = mean * np.sqrt(len(cut))
        out[:, 2 * i + 1] = np.sqrt(np.maximum(((part - mean[:, None]) ** 2).sum(axis=1), 0))
    return out


def resolutions(dims: int) -> list[int]:
    """1, 4, 16, ... segments, as long as a segment has more than one component."""
    out, s = [], 1
    while s * 2 <= dims:
        out.append(s)
        s *= 4
    return out or [1]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of `dims` whole numbers: longer lists are cut, shorter ones filled up with 0."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.minimum(np.diff(offsets), dims)
    inside = np.arange(dims)[None, :] < sizes[:, None]
    out = np.zeros((len(sizes), dims), np.int64)
    out[inside] = values[(offsets[:-1, None] + np.arange(dims)[None, :])[inside]]
    return out


class Best:
    """The k best candidates so far of every query of a block."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int):
        self.queries, self.ids, self.k, self.least = queries, ids, k, least.copy()
        self.levels = [(s, features(queries, s)) for s in resolutions(queries.shape[1])]
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.largest = float(max(np.abs(queries).max(initial=0), 1))

    def look(self, rows: np.ndarray, ids: np.ndarray) -> None:
        """Compare these candidates with all queries."""
        size = self.largest * float(max(np.abs(rows).max(initial=0), 1)) * max(rows.shape[1], 1)
        kind = np.float64 if size < 2**52 else np.int64  # floats are exact below; whole numbers are slower
        slack, v = 1e-9 * size + 1e-6, rows.astype(kind)
        marks = [features(rows, s) for s, _ in self.levels]
        for low in range(0, len(self.ids), QUERIES_AT_ONCE):
            mine = slice(low, low + QUERIES_AT_ONCE)
            left, mask = np.arange(len(ids)), self.ids[mine, None] != ids[None, :]
            for (_, fq), fv in zip(self.levels, marks, strict=True):
                mask = mask & (fq[mine] @ fv[left].T + slack >= self.least[mine, None])
                some = mask.any(axis=0)
                left, mask = left[some], mask[:, some]
            if not len(left):
                continue
            score = self.queries[mine].astype(kind) @ v[left].T
            mask &= score >= self.least[mine, None]
            for i in np.flatnonzero(mask.any(axis=1)).tolist():
                self.keep(low + i, score[i, mask[i]].astype(np.int64), ids[left[mask[i]]])

    def keep(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.found[query][0], score), np.append(self.found[query][1], ids)
        best = np.lexsort((ids, -score))[: self.k]
        self.found[query] = score[best], ids[best]
        if len(best) == self.k:  # k candidates score at least this, so one of a lower bound is out
            self.least[query] = max(self.least[query], score[best[-1]])

    def batch(self) -> pa.RecordBatch:
        many = [len(s) for s, _ in self.found]
        columns = (np.repeat(self.ids, many), np.concatenate([i for _, i in self.found]), np.concatenate([s for s, _ in self.found]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, vector: components as floor(1024 * x); vectors that are null or hold null or non-finite components go, and those of a null vec_id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * 1024)).alias("vector"))


def scanned(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """OUT: each task's k best candidates of every query that score at least `least`."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, ids, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, least = shared.value
        best, dims = Best(queries, ids, least, k), queries.shape[1]
        at_once = max(1, COMPONENTS_AT_ONCE // max(dims, 1))
        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                part = batch.slice(low, at_once)
                best.look(matrix(part.column(1), dims), part.column(0).to_numpy())
        yield best.batch()

    return rows.select("vec_id", "vector").mapInArrow(run, OUT)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row with all rows of other ids.

    vectors: vec_id, embedding. Missing components of the shorter of two vectors count as 0, so an empty vector scores 0
    with all. Ties go to the smaller vec_id. Repeated rows count each as candidates; as queries, rows of one vec_id are
    one, that of the smallest vector. A vector may have any number of components. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark, rows = vectors.sparkSession, saved(whole_numbers(vectors))
    dims = F.size("vector")
    queries = saved(rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    n, counts = rows.count(), queries.agg(F.count("*").alias("n"), F.coalesce(F.max(dims), F.lit(0)).alias("dims")).first()
    blocks = max(1, -(-counts["n"] * max(counts["dims"], 1) * 8 // BLOCK_BYTES))
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(max(1, n // FIRST_LOOK))) == 0)
    out = []
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "vector").toArrow()  # BLOCK_BYTES, about
        if not mine.num_rows:
            continue
        ids = mine.column("vec_id").to_numpy()
        q = matrix(mine.column("vector").combine_chunks(), max(len(x) for x in mine.column("vector").to_pylist()))
        order = np.argsort(ids)
        ids, q = ids[order], q[order]
        least = np.full(len(ids), NONE)
        if n > FIRST_LOOK:
            first = ranked(scanned(some, q, ids, least, k), k).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query
            least[np.searchsorted(ids, first.column("query_id").to_numpy())] = first.column("score").to_numpy()
        out.append(scanned(rows, q, ids, least, k))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(reduce(DataFrame.unionByName, out), k).select("query_id", "rank", "vec_id", "score")
