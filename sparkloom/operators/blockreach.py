"""Reach so dense that most pairs are in it: a task follows a block of seeds, as bits of every node, and reads all edges in pieces, level by level.

Nothing is shuffled but seeds and results, which name what is not reached. A task holds a row of bits of every node, twice; where
nodes are very many, its block has fewer seeds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import edgefiles
from sparkloom.operators.places import in_order
from sparkloom.scratch import fresh_path, saved

#: Numbers of 64 bits in a node's row at most, and bytes of the rows of all nodes, about. Rows that are gathered at once.
WORDS, STATE_BYTES, TILE = 16, 128_000_000, 4096
#: Of a block's hubs one in so many may miss a node that is no stray for them; a hub that misses one in so many nodes is none; a hub may miss so many others.
MISSING, POOR, LACKS = 16, 8, 4


@dataclass(frozen=True)
class Numbered:
    """Hops between nodes that are numbers from 0 to n - 1.

    nodes: id, node. hops: a, b. facts: node, methods, entries (rows of known nodes and entries among them), arrives, leaves (whether
    a hop leads there, or from there). into: file of hops by where they lead to; out: by where they come from.
    """

    n: int
    nodes: DataFrame
    hops: DataFrame
    facts: DataFrame
    into: str
    out: str
    facts_path: str

    @property
    def width(self) -> int:
        """Seeds of a block."""
        return 64 * max(1, min(WORDS, STATE_BYTES // (8 * max(self.n, 1))))

    def of(self, seeds: DataFrame) -> DataFrame:
        """node of the seeds (method_id) that hop anywhere."""
        return self.nodes.join(seeds.select(F.col("method_id").alias("id")).distinct(), "id").select("node").join(self.facts.where("leaves").select("node"), "node", "left_semi")


def numbered(hops: DataFrame, known: DataFrame) -> Numbered:
    """The hops (a, b, distinct) and known nodes (node, is_entry; a node may stand there several times)."""
    hops = hops.where("a IS NOT NULL AND b IS NOT NULL")
    ids = hops.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = in_order(ids.select(F.lit(0).alias("seed"), F.lit(False).alias("crosses"), "id"), ["id"])[0]
    nodes = saved(rows.select("id", (F.col("place") - 1).cast("int").alias("node")))
    side = lambda old, new: nodes.select(F.col("id").alias(old), F.col("node").alias(new))
    pairs = saved(hops.join(side("a", "from"), "a").join(side("b", "to"), "b").select(F.col("from").alias("a"), F.col("to").alias("b")))
    counted = known.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("methods"), F.count_if("is_entry").alias("entries"))
    ends = lambda c, flag: pairs.select(F.col(c).alias("node")).distinct().withColumn(flag, F.lit(True))
    facts = nodes.join(counted, "id", "left").join(ends("b", "arrives"), "node", "left").join(ends("a", "leaves"), "node", "left")
    facts = facts.select("node", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("methods", "entries")), *(F.coalesce(f, F.lit(False)).alias(f) for f in ("arrives", "leaves")))
    path = fresh_path(hops.sparkSession)
    facts.write.parquet(path)
    facts = hops.sparkSession.read.schema(facts.schema).parquet(path)
    return Numbered(nodes.count(), nodes, pairs, facts, edgefiles.stored(pairs, "b", "a"), edgefiles.stored(pairs, "a", "b"), path)


def _gathered(state: np.ndarray, live: np.ndarray, into: np.ndarray, piece: edgefiles.Piece) -> None:
    """Adds to each node of the piece the bits of those that its edges lead to."""
    starts, ends = piece.starts, piece.ends
    alive = live[ends]
    n = int(np.count_nonzero(alive))
    if n < len(ends):
        starts, ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(alive)))[starts], ends[alive]
    counts = np.diff(starts)
    some = np.flatnonzero(counts)
    some = some[np.argsort(-counts[some], kind="stable")]
    for i in range(0, len(some), TILE):
        rows = some[i : i + TILE]
        first, many = starts[rows], counts[rows]
        met = state[ends[first]]
        other = np.empty_like(met)
        k, m = 1, int(np.searchsorted(-many, -1))
        while m > 16:
            np.take(state, ends[first[:m] + k], axis=0, out=other[:m], mode="clip")
            np.bitwise_or(met[:m], other[:m], out=met[:m])
            k += 1
            m = int(np.searchsorted(-many, -k))
        for r in range(m):  # few have very many
            for j in range(first[r] + k, first[r] + many[r], TILE):
                met[r] |= np.bitwise_or.reduce(state[ends[j : min(j + TILE, first[r] + many[r])]], axis=0)
        into[piece.first + rows] |= met


def _followed(seeds: np.ndarray, n: int, path: str, most: int) -> np.ndarray:
    """Rows of bits by node: the i-th bit of those that lead to, or are led to from, the i-th seed within `most` edges."""
    state = np.zeros((n, -(-len(seeds) // 64)), np.uint64)
    at = np.arange(len(seeds))
    np.bitwise_or.at(state, (seeds, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    for _ in range(most):
        live, new = state.any(axis=1), state.copy()
        for piece in edgefiles.pieces(path):
            _gathered(state, live, new, piece)
        state = new
    return state


def _full(bits: np.ndarray) -> np.ndarray:
    """A row of the bits that are true."""
    padded = np.zeros(-(-len(bits) // 64) * 64, bool)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _misses(state: np.ndarray, nodes: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of `nodes` that lack bits of `full`, and the bits that they lack."""
    found, rows = [nodes[:0]], [state[:0]]
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        lacks = ~state[some] & full
        any_ = lacks.any(axis=1)
        found.append(some[any_])
        rows.append(lacks[any_])
    return np.concatenate(found), np.concatenate(rows)


def _unpacked(rows: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The first n bits of the rows, some rows at a time."""
    for i in range(0, len(rows), TILE):
        part = slice(i, i + TILE)
        yield part, np.unpackbits(rows[part].view(np.uint8), axis=1, count=n, bitorder="little")


def _over_blocks(dense: Numbered, seeds: DataFrame, path: str, schema: str, fields: list[tuple], work: Callable) -> DataFrame:
    """What `work` says of each block of seeds (node), given the block's seeds and columns of the facts, as columns of `fields`."""
    width, n, facts_path = dense.width, dense.n, dense.facts_path
    rows = in_order(seeds.select(F.lit(0).alias("seed"), F.lit(False).alias("crosses"), "node"), ["node"])[0]
    blocks = saved(rows.groupBy(F.floor((F.col("place") - 1) / width).alias("block")).agg(F.sort_array(F.collect_list("node")).alias("nodes")))
    many = blocks.count()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = None
        for nodes in (x for batch in batches for x in batch["nodes"].to_pylist()):
            edgefiles.keep_only(path)
            facts = facts if facts is not None else _facts(facts_path, n)
            for columns in work(np.array(nodes), *facts):
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return blocks.repartitionByRange(max(many, 1), "block").mapInArrow(told, schema)


def _facts(path: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """methods, entries, arrives by node."""
    methods, entries, arrives = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
    for batch in edgefiles.batches(path):
        at = batch["node"].to_numpy()
        methods[at], entries[at], arrives[at] = batch["methods"].to_numpy(), batch["entries"].to_numpy(), batch["arrives"].to_numpy(zero_copy_only=False)
    return methods, entries, arrives


def hubs(dense: Numbered, seeds: DataFrame, most: int) -> DataFrame:
    """node, good: of the seeds the good hubs, which within `most` hops reach all known nodes that any hop leads to, but strays; and those strays (good is false), each once a block or less."""
    n, path = dense.n, dense.into

    def work(seeds, methods, entries, arrives):
        state = _followed(seeds, n, path, most)
        ever = np.flatnonzero((methods > 0) & arrives)
        good = np.ones(len(seeds), bool)

        def missed(nodes, rows):
            sums = np.zeros(len(seeds), np.int64)
            for _, bits in _unpacked(rows, len(seeds)):
                sums += bits.sum(axis=0, dtype=np.int64)
            return sums

        nodes, rows = _misses(state, ever, _full(good))
        good &= missed(nodes, rows) * POOR <= len(ever)
        rows &= _full(good)
        often = np.bitwise_count(rows).sum(axis=1, dtype=np.int64) * MISSING > np.count_nonzero(good)
        good &= missed(nodes[~often], rows[~often]) <= LACKS
        rows &= _full(good)
        strays = nodes[rows.any(axis=1)]
        yield np.concatenate((seeds[good], strays)), np.arange(np.count_nonzero(good) + len(strays)) < np.count_nonzero(good)

    return _over_blocks(dense, seeds, path, "node int, good boolean", [("node", pa.int32()), ("good", pa.bool_())], work)


def counts(dense: Numbered, seeds: DataFrame, most: int) -> DataFrame:
    """node, n_methods, n_entries: how many known nodes, and entries among them, each seed reaches within `most` hops, itself among them."""
    n, path = dense.n, dense.into

    def work(seeds, methods, entries, arrives):
        state = _followed(seeds, n, path, most)
        known = np.flatnonzero(methods)
        weights = np.stack((methods, entries)).astype(np.float64)
        sums = np.repeat(weights.sum(axis=1, keepdims=True), len(seeds), axis=1)
        nodes, rows = _misses(state, known, _full(np.ones(len(seeds), bool)))
        for part, bits in _unpacked(rows, len(seeds)):
            sums -= weights[:, nodes[part]] @ bits.astype(np.float64)
        yield seeds, sums[0].astype(np.int64), sums[1].astype(np.int64)

    return _over_blocks(dense, seeds, path, "node int, n_methods long, n_entries long", [("node", pa.int32()), ("n_methods", pa.int64()), ("n_entries", pa.int64())], work)


def lacking(dense: Numbered, targets: DataFrame, most: int) -> DataFrame:
    """node, methods, entries: how many of the targets, and entries among them, a node does not reach within `most` hops; a row a block at most, none where it reaches all."""
    n, path = dense.n, dense.out

    def work(targets, methods, entries, arrives):
        state = _followed(targets, n, path, most)
        weights = np.stack((methods[targets], entries[targets]), axis=1).astype(np.float64)
        nodes, rows = _misses(state, np.arange(n), _full(np.ones(len(targets), bool)))
        for part, bits in _unpacked(rows, len(targets)):
            less = (bits.astype(np.float64) @ weights).astype(np.int64)
            yield nodes[part], less[:, 0], less[:, 1]

    return _over_blocks(dense, targets, path, "node int, methods long, entries long", [("node", pa.int32()), ("methods", pa.int64()), ("entries", pa.int64())], work)
