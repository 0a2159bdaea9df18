"""Edges as files that tasks read whole, in pieces: what is asked of all edges again for each of many blocks shuffles nothing.

Nodes are whole numbers below 2^31. Files lie in the shared folder; a worker keeps the pieces of up to HELD_EDGES edges from one
block to the next, and of what is more it holds one piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import fresh_path

#: Edges that a worker keeps, of all files, and of a piece.
HELD_EDGES, PIECE = 48_000_000, 1 << 20
_held: dict[str, list] = {}


@dataclass(frozen=True)
class Piece:
    """Edges of the nodes from `first` on: those of the i-th lead to ends[starts[i]:starts[i + 1]], each as often as `many` says (once where that is None)."""

    first: int
    starts: np.ndarray
    ends: np.ndarray
    many: np.ndarray | None


def stored(edges: DataFrame, by: str, end: str, many: str | None = None) -> str:
    """The path of `edges` in order of `by`."""
    spark, path = edges.sparkSession, fresh_path(edges.sparkSession)
    rows = edges.select(F.col(by).cast("int").alias("node"), F.col(end).cast("int").alias("end"), *([F.col(many).cast("long").alias("many")] if many else []))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "node").sortWithinPartitions("node", "end").write.parquet(path)
    return path


def batches(path: str, rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of a saved table, read by this task itself."""
    store, root = fs.FileSystem.from_uri(path)
    for name in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with store.open_input_file(name) as source:
            yield from pq.ParquetFile(source).iter_batches(rows)


def _read(path: str) -> Iterator[Piece]:
    for batch in batches(path):
        if not batch.num_rows:
            continue
        nodes, ends = batch["node"].to_numpy(), batch["end"].to_numpy()
        first, many = int(nodes[0]), None
        if "many" in batch.schema.names:
            many = batch["many"].to_numpy()
            many = None if many.max() == 1 else many.astype(np.min_scalar_type(many.max()) if many.max() < 1 << 31 else np.int64)
        starts = np.zeros(int(nodes[-1]) - first + 2, np.int32)
        np.cumsum(np.bincount(nodes - first), out=starts[1:])
        yield Piece(first, starts, ends, many)


def keep_only(*paths: str) -> None:
    """What a task begins with: pieces of other files are kept no longer."""
    for path in set(_held) - set(paths):
        del _held[path]


def pieces(path: str) -> Iterator[Piece]:
    """The pieces of the edges at `path`."""
    if path in _held:
        yield from _held[path]
        return
    kept, n = [], sum(len(p.ends) for some in _held.values() for p in some)
    for piece in _read(path):
        n += len(piece.ends)
        if n <= HELD_EDGES:
            kept.append(piece)
        else:
            kept.clear()
        yield piece
    if n <= HELD_EDGES:
        _held[path] = kept
