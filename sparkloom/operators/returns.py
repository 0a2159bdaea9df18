"""Numbers of closed walks by their least method, counted in tasks: each holds the half walks of a few methods and reads all hops in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.operators import edgefiles

#: Walks of two hops that are held at once, about; hops of a task's methods; walks that are looked up at once.
HELD_WALKS, HOPS_A_TASK, AT_ONCE = 2_000_000, 230_000, 1 << 18
RETURNS = pa.schema([("a", pa.int64()), ("length", pa.int32()), ("walks", pa.int64())])


def _from_ends(node: np.ndarray, lo: np.ndarray, many: np.ndarray, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Walks (node, lo, many), sorted by node, with one hop more: (end, lo, many), AT_ONCE at a time or what one walk has more."""
    for piece in edgefiles.pieces(path):
        first, last = np.searchsorted(node, (piece.first, piece.first + len(piece.starts) - 1))
        if first == last:
            continue
        order = first + np.argsort(lo[first:last], kind="stable")  # ends of one `lo` are looked up together
        at, low, ways_of = node[order] - piece.first, lo[order], many[order]
        start, count = piece.starts[at].astype(np.int64), piece.starts[at + 1] - piece.starts[at]
        upto = np.cumsum(count, dtype=np.int64)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, "right")))
            some = count[i:j]
            total = int(some.sum())
            if total:
                before = np.cumsum(some) - some
                pos = np.arange(total) + np.repeat(start[i:j] - before, some)
                ways = np.repeat(ways_of[i:j], some)
                yield piece.ends[pos], np.repeat(low[i:j], some), ways if piece.many is None else ways * piece.many[pos]
            i = j


def _summed(key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its `many`."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(many[order], new) if len(key) else many


class _Table:
    """Sums by method (its place `lo`) and end, behind bytes that say of most other ends that they are not there: those of one method lie together."""

    def __init__(self, lo: np.ndarray, end: np.ndarray, many: np.ndarray, n_own: int, n: int):
        key = lo * n + end
        order = np.argsort(key)
        self.n, self.key, self.many = n, key[order], many[order]
        bits = np.maximum(4, np.ceil(np.log2(16 * np.maximum(np.bincount(lo, minlength=n_own), 1))).astype(np.int64))
        self.base, self.shift = np.cumsum(1 << bits) - (1 << bits), (32 - bits).astype(np.uint32)
        self.there = np.zeros(int((1 << bits).sum()), bool)
        self.there[self._place(lo, end)] = True

    def _place(self, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.base[lo] + ((end.astype(np.uint32) * np.uint32(0x9E3779B1)) >> self.shift[lo])

    def met(self, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are there, and their sums."""
        maybe = np.flatnonzero(self.there[self._place(lo, end)])
        if not len(self.key):
            return maybe[:0], self.many
        key = lo[maybe] * self.n + end[maybe]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        sure = self.key[at] == key
        return maybe[sure], self.many[at[sure]]


def _block(own: np.ndarray, n: int, most: int, out_path: str, in_path: str) -> dict[int, np.ndarray]:
    """By length, the walks of each method of `own` (in order) that return to it by later methods alone."""
    place = np.arange(len(own))
    ones = np.ones(len(own), np.int64)
    sums = {length: np.zeros(len(own), np.int64) for length in range(1, most + 1)}

    def grown(walks, path, loops=None):
        """The walks with one hop more, to later methods alone, in order of their ends."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for end, lo, many in _from_ends(*walks, path):
            if loops is not None:
                np.add.at(loops, lo[end == own[lo]], many[end == own[lo]])
            later = end > own[lo]
            found.append((end[later].astype(np.int64) * len(own) + lo[later], many[later]))
        key, many = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return key // len(own), key % len(own), many

    def table(walks):
        node, lo, many = walks
        return _Table(lo, node, many, len(own), n)

    def close(length, chunks, back):
        for end, lo, many in chunks:
            hit, rest = back.met(lo, end)
            if len(hit):
                ways, lo = many[hit], lo[hit]
                if (float(np.max(np.abs(ways))) * float(np.max(np.abs(rest)))) * len(hit) + float(np.max(sums[length])) >= 2.0**63:
                    raise ArithmeticError("more closed walks than a long counts")
                np.add.at(sums[length], lo, ways * rest)

    start = (own, place, ones)
    out, back = {1: grown(start, out_path, sums[1])}, {1: grown(start, in_path)}
    if most > 1:
        first = table(back[1])
        close(2, [out[1]], first)
    if most > 2:
        out[2] = grown(out[1], out_path)
        close(3, [out[2]], first)
    if most > 3:
        back[2] = grown(back[1], in_path)
        second = table(back[2])
        close(4, [out[2]], second)
    if most > 4:
        close(5, _from_ends(*out[2], out_path), second)
    return sums


def _degrees(n: int, path: str) -> np.ndarray:
    """How many hops each node has in the files at `path`."""
    found = np.zeros(n, np.int64)
    for piece in edgefiles.pieces(path):
        found[piece.first : piece.first + len(piece.starts) - 1] += np.diff(piece.starts)
    return found


def _two_hops(own: np.ndarray, n: int, path: str) -> np.ndarray:
    """How many walks of two hops begin at each method of `own`, at most."""
    degrees, found = _degrees(n, path), np.zeros(len(own), np.int64)
    place = np.arange(len(own))
    for end, lo, _ in _from_ends(own, place, np.ones(len(own), np.int64), path):
        np.add.at(found, lo, degrees[end] * (end > own[lo]))
    return found


def first_returns(hops: DataFrame, n: int, most: int) -> DataFrame:
    """a, length, walks: closed walks of up to `most` hops (5 at most) from a on that come by later methods alone, and by `a` at their end.

    hops: a, b, many; methods are numbers below `n`. Every task has methods of all places in the order, and of these it holds the
    ends of walks of two hops there and back for some at a time; the walks of a third hop are looked up as the hops are read.
    """
    spark = hops.sparkSession
    out_path, in_path = edgefiles.stored(hops, "a", "b", "many"), edgefiles.stored(hops, "b", "a", "many")
    many = hops.count()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), many // 1000), many // HOPS_A_TASK)

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for batch in rows for t in batch["id"].to_pylist()):
            edgefiles.keep_only(out_path, in_path)
            own = np.arange(task, n, tasks)
            walks = np.cumsum(np.maximum(_two_hops(own, n, out_path), _two_hops(own, n, in_path)))
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(walks, (walks[i - 1] if i else 0) + HELD_WALKS, "right")))
                for length, sums in _block(own[i:j], n, most, out_path, in_path).items():
                    some = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i:j][some]), pa.array(np.full(len(some), length, np.int32)), pa.array(sums[some])], schema=RETURNS)
                i = j

    return spark.range(0, tasks, 1, tasks).mapInArrow(counted, "a long, length int, walks long")
