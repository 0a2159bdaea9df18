"""Similarity join on word shingles by chosen paths.

Texts are sets of hashed five-word runs; texts with the same set are joined first and go on as one. In each of several
independent runs a set picks each of its shingles with chance 1 / (threshold * size), by a hash that all sets share, so
that two sets of Jaccard similarity at or above the threshold pick at least one common shingle on average. A bucket
holds the sets that picked the same. Small buckets are compared by brute force; large ones are split again, the path so
far being part of the hash, to a given depth; what is still large then is compared in blocks of bounded size, block by
block, so nothing is left out. The number of runs follows from the recall asked for: a pair of just the threshold
survives `depth` levels with chance f(d) = 1 - exp(-f(d-1)), f(0) = 1, and runs repeat until 1 - (1 - f)^runs reaches it.

No pairs are emitted. A task counts links by set and reports a spanning forest of its bucket; a pair that meets in
several buckets counts in the first alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.words import distinct_per_text, iter_words, mix, shingles
from sparkloom.scratch import saved

WIDTH, THRESHOLD, RECALL, DEPTH = 5, 0.8, 0.999, 3
#: Sets in a bucket that is compared at once, and in a block of a bucket that no further split made small.
SMALL, BLOCK = 256, 2048
#: Shingles of a block, about (32 MB): buckets of very long texts are cut to more blocks.
BLOCK_SHINGLES = 4_000_000
#: Bits of a shingle's hash that sets are compared by, a multiple of 8.
BITS_KEPT = 48
#: A null doc_id while it is worked on.
NO_ID = -(2**63)
_WHOLE = float(2**64)


def survival(depth: int) -> float:
    """The chance of a pair at the threshold to survive `depth` levels of a run."""
    chance = 1.0
    for _ in range(depth):
        chance = 1 - math.exp(-chance)
    return chance


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def limits(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The hash up to which a set of this size picks a shingle."""
    return np.minimum(_WHOLE / (threshold * np.maximum(sizes, 1)), _WHOLE - 4096).astype(np.uint64)


def seed_of(run: int) -> np.uint64:
    return mix(np.array([run + 1], np.uint64) * np.uint64(0xA0761D6478BD642F))[0]


def first_keys(values: np.ndarray, starts: np.ndarray, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of all runs by text, and where each text's begin (and the end)."""
    sizes = np.diff(starts)
    limit = np.repeat(limits(sizes, threshold), sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for run in range(runs):
        seed = seed_of(run)
        picked = np.flatnonzero(mix(values ^ seed) <= limit)
        keys.append(mix(values[picked] + seed))
        owners.append(owner[picked])
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return key[order], np.searchsorted(own[order], np.arange(len(sizes) + 1))


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for w in iter_words(column):
        yield distinct_per_text(*shingles(w, WIDTH))


def digests(values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """h1, h2 (a 128-bit digest) and n (the size) of each set."""
    out = []
    for salt in (0, 0x51ED270B):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64))
    return [*out, np.diff(starts).astype(np.int64)]


def sketches(docs: DataFrame, runs: int, threshold: float) -> DataFrame:
    """doc_id, mark (the text's hash), h1, h2, n (of digests()), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for values, starts in _sets(batch.column(1)):
                keys, at = first_keys(values, starts, runs, threshold)
                out[3].append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64))))
                for column, digest in zip(out, digests(values, starts), strict=False):
                    column.append(digest)
            if out[3]:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.concatenate(c), pa.int64()) for c in out[:3]), pa.concat_arrays(out[3])], names=["doc_id", "mark", "h1", "h2", "n", "keys"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark long, h1 long, h2 long, n long, keys array<long>")


def packed(values: np.ndarray) -> bytes:
    """Distinct numbers by their upper BITS_KEPT bits, in rising order. Two sets of 20,000 take one shingle for another with chance 1.4e-6."""
    upper = np.unique(values >> np.uint64(64 - BITS_KEPT))
    return upper.view(np.uint8).reshape(-1, 8)[:, : BITS_KEPT // 8].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    size = BITS_KEPT // 8
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def set_rows(docs: DataFrame) -> DataFrame:
    """rep, shingles: the packed set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [packed(values[a:b]) for values, starts in _sets(batch.column(1)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def children(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """key, rep: the next level of the buckets key, rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, reps = [], []
            for rep, paths, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = unpacked(raw)
                limit = limits(np.array([len(values)]), threshold)[0]
                for path in np.array(paths, np.int64).view(np.uint64):
                    new = mix(values[mix(values ^ path) <= limit] + path)
                    keys.append(new)
                    reps += [rep] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array(reps, pa.int64())], names=["key", "rep"])

    paths = rows.groupBy("rep").agg(F.collect_list("key").alias("paths"))  # a few dozen paths a set
    return paths.join(sets, "rep").select("rep", "paths", "shingles").mapInArrow(run, "key long, rep long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    out, width = np.zeros((n, n), np.float32), 4096
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((n, width), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return out


def compare(key: int, side: np.ndarray, apart: bool, reps: np.ndarray, copies: np.ndarray, keys: list[list[int]], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links by set that this bucket is the first to see, and the least rep that each set is connected with here.

    apart: only pairs of unlike `side` are compared (two blocks of one bucket).
    """
    n, sizes = len(reps), np.array([len(s) for s in sets], float)
    common, linked = common_counts(sets), np.zeros((n, n), bool)
    # a few rows at a time: whole tables of 64-bit numbers would be the largest thing in a task
    rows = [slice(low, low + 256) for low in range(0, n, 256)]
    for r in rows:
        linked[r] = common[r] >= threshold / (1 + threshold) * (sizes[r, None] + sizes[None, :]) - 1e-9
        if apart:
            linked[r] &= side[r, None] != side[None, :]
    del common
    np.fill_diagonal(linked, False)
    if not linked.any():
        return np.zeros(n, np.int64), reps
    touched = np.flatnonzero(linked.any(axis=1))
    earlier: dict[int, list[int]] = {}
    for i in touched.tolist():
        for k in keys[i]:
            if k < key:
                earlier.setdefault(k, []).append(i)
    met = [m for m in earlier.values() if len(m) > 1]
    seen = np.zeros((n, len(met)), np.float32)
    for c, m in enumerate(met):
        seen[m, c] = 1
    links = np.zeros(n, np.int64)
    for r in rows:
        counted = linked[r] & ~(seen[r] @ seen.T > 0) if met else linked[r]
        links[r] = counted @ copies
    labels = np.argsort(np.argsort(reps, kind="stable"), kind="stable").astype(np.int32)
    while True:
        new = labels.copy()
        for r in rows:
            new[r] = np.minimum(labels[r], np.where(linked[r], labels[None, :], np.int32(n)).min(axis=1))
        if (new == labels).all():
            break
        labels = new
    return links, np.sort(reps)[labels]


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> pa.RecordBatch:
            key, i, j = at
            _, _, _, side, reps, copies, keys, sets = zip(*rows, strict=True)
            links, root = compare(key, np.array(side), i != j, np.array(reps, np.int64), np.array(copies, np.int64), keys, [unpacked(x) for x in sets], threshold)
            some = (links > 0) | (root != np.array(reps))
            return pa.RecordBatch.from_arrays([pa.array(np.array(reps, np.int64)[some]), pa.array(root[some].astype(np.int64)), pa.array(links[some].astype(np.int64))], names=["rep", "root", "links"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if len(rows) > 1:
                        yield done()
                    at, rows = row[:3], []
                rows.append(row)
        if len(rows) > 1:
            yield done()

    return run


def shared_keys(rows: DataFrame) -> DataFrame:
    """key, rep, in_bucket of the buckets of at least two."""
    counts = rows.groupBy("key").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    return rows.join(counts, "key")


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id, n_links: one row per document row.

    Two documents are linked if the Jaccard similarity of their sets of five-word runs (words as in `words`; a text of
    one to four words is one run) is at least `threshold`. n_links is the number of other documents a document is linked
    with, copies included; class_id is the least doc_id that links lead to, by any number of steps. A text without words
    (null and empty ones too) is linked with none and is its own class. A null doc_id counts as the smallest. Links of a pair at the threshold are found with chance `recall` at least, others with a higher one.
    Rows of one doc_id, or of a null one, are documents of their own, whatever their texts. A text of any length is taken whole. An empty table gives
    an empty one; other columns are ignored, whatever their names.
    """
    runs = runs_for(recall, depth)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    sketched = saved(sketches(docs, runs, threshold))
    sets_of = sketched.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("carrier"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"))
    # a set has a number of its own, whatever ids its texts have; the text of the least id (then hash) carries it
    reps = saved(sets_of.select("h1", "h2", "n", "copies", "keys", F.col("carrier.doc_id").alias("least"), F.col("carrier.mark").alias("mark"), F.monotonically_increasing_id().alias("rep")))
    level = shared_keys(reps.select("rep", F.explode(F.array_distinct("keys")).alias("key")))
    level = saved(level)
    active = level.select("rep").distinct()
    of = ["h1", "h2", "n"]
    carriers = reps.join(active, "rep").select("rep", F.col("least").alias("doc_id"), "mark")
    sets = saved(set_rows(docs.join(carriers, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])))
    found = level.where(F.col("in_bucket") <= SMALL)
    for step in range(1, depth):
        large = level.where(F.col("in_bucket") > SMALL)
        if large.isEmpty():
            break
        level = saved(shared_keys(children(large.select("key", "rep"), sets, threshold).distinct()))
        found = found.unionByName(level if step == depth - 1 else level.where(F.col("in_bucket") <= SMALL))
    # of buckets with the same members one is enough
    member = F.sum(F.xxhash64("rep").cast("decimal(38,0)"))
    signed = found.join(reps.select("rep", "n"), "rep").groupBy("key").agg(member.alias("a"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("b"), F.count("*").alias("c"), F.sum("n").alias("shingles_in"))
    unlike = signed.groupBy("a", "b", "c").agg(F.min("key").alias("key"), F.min("shingles_in").alias("shingles_in")).select("key", "shingles_in")
    buckets = saved(found.join(unlike, "key"))
    listed = buckets.groupBy("rep").agg(F.collect_list("key").alias("keys")).join(reps.select("rep", "copies"), "rep").join(sets, "rep")
    blocks = F.greatest(F.when(F.col("in_bucket") <= SMALL, 1).otherwise(F.ceil(F.col("in_bucket") / BLOCK)), F.least(F.ceil(F.col("shingles_in") / BLOCK_SHINGLES), F.col("in_bucket"))).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = buckets.withColumn("blocks", blocks).withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep")
    rows = dealt.join(listed, "rep").select("key", "i", "j", "side", "rep", "copies", "keys", "shingles")
    links = saved(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared(threshold), "rep long, root long, links long"))
    classes = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = classes.withColumnRenamed("node", "rep").join(reps.select("rep", "least"), "rep")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("class_least")), "component").select("rep", "class_least")
    by_rep = reps.select(*of, "rep", "least", "copies").join(counts, "rep", "left").join(named, "rep", "left")
    joined = sketched.select("doc_id", *of).join(by_rep, of, "left")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    return joined.select(
        real(F.col("doc_id")).alias("doc_id"),
        real(F.coalesce("class_least", "least", "doc_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
    )
