"""Texts as sets of hashed features, and linear models over them.

Features of a text: its distinct words, their first four and five bytes (which join the inflected forms of a stem) and,
on request, steps of shape statistics. All are buckets of a table of 2 ** BITS weights, so a model has a fixed size.

Models are fitted by Spark. Tasks count the buckets of their texts and the counts are summed by blocks; rows over the
chosen buckets alone are dealt to parts of bounded size and written. Then, round after round, each part takes gradient
steps from the same weights and Spark averages what the parts came to. Only vectors over features reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.words import Words, iter_words, mix
from sparkloom.scratch import saved

BITS = 20
#: Values in a block of a vector that is summed by Spark, and blocks summed by a task.
BLOCK, FAN_IN = 4096, 64
#: Rows in a part of the training rows, about; it bounds a task's memory.
ROWS_IN_PART = 20_000
VECTOR = "block int, task int, at binary, value binary"
#: Shape statistics, each a share between 0 and 1, and steps at which it gives a feature.
STEPS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|~^<>{}[]=+@_\\")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def shapes(words: Words) -> np.ndarray:
    """Shares by text: capitals, digits, symbols, marks and line ends among bytes; repeated and adjacent-repeated words; long words; length."""
    n = len(words.text) - 1
    size = np.maximum(np.diff(words.text), 1)
    count = np.diff(words.first)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[words.text]) / size

    owner = np.repeat(np.arange(n), count)
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (words.hashes >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    same = np.zeros(len(owner), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    least = np.maximum(count, 1)
    longs = np.bincount(owner, weights=np.minimum(words.end - words.begin, 40) / 40, minlength=n)
    return np.stack([share(_CAPITAL[words.data]), share(_DIGIT[words.data]), share(_SYMBOL[words.data]), share(_MARK[words.data]), share(words.data == 10), 1 - distinct / least, np.bincount(owner, weights=same, minlength=n) / least, longs / least, np.minimum(np.log1p(count) / 10, 1)], axis=1)


def features(words: Words, shaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct buckets in rising order, and where each text's begin (and the end)."""
    n = len(words.first) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(words.first)) << np.uint64(32)
    top = np.uint64(64 - BITS)
    parts = [owner | (words.hashes >> top)]
    parts += [owner | (mix(words.prefixes(size) + np.uint64(size)) >> top) for size in (4, 5)]
    if shaped:
        rows, stats, steps = np.nonzero(shapes(words)[:, :, None] >= np.asarray(STEPS)[None, None, :])
        code = mix((stats * 64 + steps + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> top
        parts.append((rows.astype(np.uint64) << np.uint64(32)) | code)
    key = np.concatenate(parts)
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    starts = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int32), starts


def as_blocks(task: int, vector: np.ndarray) -> pa.RecordBatch:
    """The values other than 0 of a vector, by block."""
    at = np.flatnonzero(vector)
    block = at // BLOCK
    cut = np.flatnonzero(np.diff(block)) + 1
    parts = np.split(at, cut) if len(at) else []
    numbers = [int(x[0]) // BLOCK for x in parts]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([(x % BLOCK).astype(np.uint16).tobytes() for x in parts], pa.binary()), pa.array([vector[x].astype(np.float64).tobytes() for x in parts], pa.binary())], names=["block", "task", "at", "value"])


def _one_block(group: pa.Table) -> np.ndarray:
    out = np.zeros(BLOCK)
    for at, value in zip(group.column("at").to_pylist(), group.column("value").to_pylist(), strict=True):
        out[np.frombuffer(at, np.uint16)] += np.frombuffer(value)
    return out


def summed(blocks: DataFrame, tasks: int, size: int) -> np.ndarray:
    """The sum of the vectors of `tasks` tasks (VECTOR): FAN_IN of a block at a time, so that no task holds more."""

    def one(group: pa.Table) -> pa.Table:
        vector = np.zeros(BLOCK * (group.column("block")[0].as_py() + 1))
        vector[-BLOCK:] = _one_block(group)
        return pa.Table.from_batches([as_blocks(group.column("task")[0].as_py(), vector)])

    while True:
        blocks = blocks.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("block", "task").applyInArrow(one, VECTOR)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros(size + -size % BLOCK)
    for row in blocks.toLocalIterator():  # one row a block of the vector
        out[row["block"] * BLOCK :][:BLOCK][np.frombuffer(row["at"], np.uint16)] += np.frombuffer(row["value"])
    return out[:size]


@dataclass
class Counts:
    """How many rows there are, and how many of them have each bucket; of the flagged ones and of all."""

    flagged_rows: int
    rows: int
    flagged: np.ndarray
    all: np.ndarray


def bucket_counts(rows: DataFrame, shaped: bool) -> Counts:
    """Counts over all rows of flag (boolean), text."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros(2 * size + 2)
        for batch in batches:
            flags = np.asarray(batch.column(0).to_pylist(), bool)
            for w in iter_words(batch.column(1)):
                buckets, starts = features(w, shaped)
                mine = flags[w.low : w.high]
                out[size : 2 * size] += np.bincount(buckets, minlength=size)
                out[:size] += np.bincount(buckets[np.repeat(mine, np.diff(starts))], minlength=size)
                out[2 * size] += mine.sum()
                out[2 * size + 1] += len(mine)
        yield as_blocks(TaskContext.get().partitionId(), out)

    found = summed(rows.select("flag", "text").mapInArrow(run, VECTOR), rows.rdd.getNumPartitions(), 2 * size + 2)
    return Counts(int(found[-2]), int(found[-1]), found[:size], found[size : 2 * size])


def compact_rows(rows: DataFrame, chosen: np.ndarray, n_rows: int, shaped: bool, rows_in_part: int = ROWS_IN_PART) -> DataFrame:
    """part, flag, packed: the rows of flag, text over the chosen buckets, numbered from 0, dealt evenly to parts and written part by part."""
    number = np.full(1 << BITS, -1, np.int32)
    number[chosen] = np.arange(len(chosen), dtype=np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for w in iter_words(batch.column(1)):
                kept = Rows(*features(w, shaped)).renumbered(shared.value)
                packed += [kept.buckets[a:b].tobytes() for a, b in zip(kept.starts[:-1], kept.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["flag", "packed"])

    parts = max(1, -(-n_rows // rows_in_part))
    made = rows.select("flag", "text").mapInArrow(run, "flag boolean, packed binary")
    return saved(made.repartition(parts).select(F.spark_partition_id().alias("part"), "flag", "packed"))


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, "Rows"]]:
    """(part, flags, rows) of the parts of a task, one after the other."""
    part, flags, packed = None, [], []
    for batch in batches:
        for p, flag, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part and packed:
                yield part, np.array(flags, bool), Rows.of(packed)
                flags, packed = [], []
            part = p
            flags.append(flag)
            packed.append(row)
    if packed:
        yield part, np.array(flags, bool), Rows.of(packed)


def averaged_rounds(compact: DataFrame, state: np.ndarray, steps: Callable[[np.ndarray, np.ndarray, "Rows", int], np.ndarray | None], rounds: int) -> np.ndarray:
    """The state after `rounds`: in each, every part's steps (state, flags, rows, seed) begin at the same state, and results are averaged by rows.

    A part for which `steps` gives None takes no part.
    """
    context, size = compact.sparkSession.sparkContext, len(state)
    for number in range(rounds):
        shared = context.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(size + 1)
            for part, flags, rows in by_part(batches):
                new = steps(shared.value.copy(), flags, rows, 1000 * number + part)
                if new is not None:
                    total += np.append(new, 1.0) * len(rows)
            yield as_blocks(TaskContext.get().partitionId(), total)

        found = summed(compact.mapInArrow(run, VECTOR), compact.rdd.getNumPartitions(), size + 1)
        state = found[:-1] / found[-1] if found[-1] else state
        shared.unpersist()
    return state


def sampled(ids: DataFrame, n: int) -> DataFrame:
    """The rows of distinct doc_id, or, where there are more than n, about n of them, chosen by a hash of doc_id."""
    ids = saved(ids)
    count = ids.count()
    steps = 1 << 40
    return ids if count <= n else ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < steps * n // count)


@dataclass
class Rows:
    """Sparse 0/1 rows: the buckets of all rows, and where each row's begin (and the end)."""

    buckets: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of(cls, packed: list[bytes]) -> "Rows":
        starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)]).astype(np.int64)
        return cls(np.frombuffer(b"".join(packed), np.int32), starts)

    def take(self, rows: np.ndarray) -> "Rows":
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes) + np.repeat(self.starts[:-1][rows], sizes)
        return Rows(self.buckets[at], starts)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Each row's sum of weights, a thousand rows at a time."""
        out = np.zeros(len(self))
        for low in range(0, len(self), 1000):
            at = self.starts[low : low + 1001]
            sums = np.concatenate([[0.0], np.cumsum(weights[self.buckets[at[0] : at[-1]]], dtype=np.float64)])
            out[low : low + 1000] = np.diff(sums[at - at[0]])
        return out

    def renumbered(self, number: np.ndarray) -> "Rows":
        """The rows over the buckets with a number, by that number; -1 stands for none."""
        kept, starts = [np.zeros(0, np.int32)], np.zeros(len(self.starts), np.int64)
        for low in range(0, len(self), 1000):
            at = self.starts[low : low + 1001]
            new = number[self.buckets[at[0] : at[-1]]]
            sums = np.concatenate([[0], np.cumsum(new >= 0)])
            starts[low + 1 : low + 1001] = starts[low] + sums[at[1:] - at[0]]
            kept.append(new[new >= 0])
        return Rows(np.concatenate(kept), starts)

    def add_to(self, out: np.ndarray, by_row: np.ndarray) -> None:
        out += np.bincount(self.buckets, weights=np.repeat(by_row, np.diff(self.starts)), minlength=len(out))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adagrad:
    """Steps that shrink with each weight's own past gradients; weight decay pulls unused weights to nothing.

    The state is the weights followed by the sums of squared gradients; `start` stands for past gradients at first, so
    that features met in a few rows alone hardly move.
    """

    def __init__(self, state: np.ndarray, rate: float, decay: float):
        self.state, self.rate, self.decay = state, rate, decay
        self.weights, self.past = np.split(state, 2)

    @staticmethod
    def beginning(weights: np.ndarray, start: float) -> np.ndarray:
        return np.concatenate([weights, np.full(len(weights), start)])

    def step(self, gradient: np.ndarray) -> None:
        gradient = gradient + self.decay * self.weights
        self.past += gradient * gradient
        self.weights -= self.rate * gradient / np.sqrt(self.past)


def telling(counts: Counts, least_z: float, least_rows: int = 5) -> np.ndarray:
    """Log ratios of how often a bucket is found in flagged rows and in all; 0 where the two shares differ by less than `least_z` standard errors, or fewer than `least_rows` rows have it."""
    n, m = max(counts.flagged_rows, 1), max(counts.rows, 1)
    a, b = counts.flagged, counts.all
    both = (a + b) / (n + m)
    z = (a / n - b / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-12)
    return np.where((np.abs(z) >= least_z) & (b >= least_rows), np.log((a + 1) / (n + 2)) - np.log((b + 1) / (m + 2)), 0.0)


def spread(kept: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of the kept buckets in the full table."""
    out = np.zeros(1 << BITS)
    out[kept] = weights
    return out


def crc_share(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo `parts`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def annotated(docs: DataFrame, model: "Model", held_out: Callable[[Column], Column], keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score (the sigmoid of the model's value for the whole text), predicted, and the columns `keep`."""
    shared, shaped, bias = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32)), model.shaped, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for w in iter_words(batch.column(1)):
                scores.append(sigmoid(Rows(*features(w, shaped)).dot(shared.value) + bias))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores), pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    scored = rows.mapInArrow(run, "doc_id long, score double" + types)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(f"keep_{c}").alias(c) for c in keep))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    shaped: bool
