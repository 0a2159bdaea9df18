"""Removal of lines that repeat across documents.

A line's key is the line without blanks (`[\\x20\\x09-\\x0D]`) at both ends, A-Z lower-cased. Two Bloom filters over the
whole table tell keys seen once from keys seen again: tasks hash the keys of their own documents to bits, the bits of
all tasks meet by blocks of the filter, and a bit that was hit twice is set in the second filter. That one alone is
broadcast. A second scan then passes on only keys that the second filter suspects of repeating; these are shuffled for
exact counts of documents and for the largest doc_id. A false suspicion costs a row, never a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import saved

BLANK = b" \t\n\x0b\x0c\r"
#: Bits of a filter: four for each key that the text's length has room for, between these bounds. The larger one bounds
#: what is broadcast (64 MB); beyond it more keys are suspected and shuffled, and results stay the same.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 4, 1 << 20, 1 << 29
PROBES = 2
#: Bits in a block of a filter, and hits that a task gathers before it passes them on.
BLOCK = 1 << 16
HITS_AT_ONCE = 4_000_000
#: Repeated keys that are broadcast (24 bytes each) to drop their lines where the texts lie; more are joined.
HELD_KEYS = 1 << 18
#: Parts that the documents of one key are spread over in that join.
SALTS = 16
#: A null doc_id while it is worked on.
NO_ID = -(2**63)


def positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """The bits of n digests (n x 2 unsigned 64-bit numbers), by double hashing: n x PROBES."""
    a, b = digests[:, 0], digests[:, 1] | np.uint64(1)
    return (a[:, None] + np.arange(1, PROBES + 1, dtype=np.uint64) * b[:, None]) & np.uint64(bits - 1)


def holds(words: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether all bits of each digest are set in the filter `words` (8-bit numbers)."""
    at = positions(digests, len(words) << 3)
    return ((words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def as_numbers(digests: Sequence[bytes]) -> np.ndarray:
    """Fixed 16-byte values as n x 2 numbers."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def line_keys(text: str, least: int) -> list[tuple[str, bytes | None]]:
    """Each line with its key's digest; none for keys of fewer than `least` code points."""
    out = []
    for line in text.split("\n"):
        digest = None
        if len(line) >= least:
            key = line.encode().strip(BLANK).lower()
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                digest = hashlib.md5(key, usedforsecurity=False).digest()
        out.append((line, digest))
    return out


def _keys_of(text: str | None, least: int) -> set[bytes]:
    return {d for _, d in line_keys(text or "", least) if d is not None}


def _hits(least: int, bits: int):
    """block, once, again: per task, the places in each block that its keys hit, and those hit by two of its documents or keys."""

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        at, times = np.unique(np.concatenate(found), return_counts=True)
        block, place = (at >> np.uint64(16)).astype(np.int32), (at & np.uint64(BLOCK - 1)).astype(np.uint16)
        cut = np.flatnonzero(np.diff(block)) + 1
        first = block[np.concatenate([[0], cut])]
        once = [x.tobytes() for x in np.split(place, cut)]
        again = [x[n > 1].tobytes() for x, n in zip(np.split(place, cut), np.split(times, cut), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(once, pa.binary()), pa.array(again, pa.binary())], names=["block", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            digests = [d for text in batch.column(0).to_pylist() for d in _keys_of(text, least)]
            if digests:
                found.append(positions(as_numbers(digests), bits).ravel())
                held += len(found[-1])
            if held > HITS_AT_ONCE:
                yield out(found)
                found, held = [], 0
        if found:
            yield out(found)

    return run


def _joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One block of the second filter: places hit twice within a task or by two tasks; as bits, or as places where those are fewer."""
    times = np.zeros(BLOCK, np.int64)
    for once, again in zip(group["once"], group["again"], strict=True):
        times[np.frombuffer(once, np.uint16)] += 1
        times[np.frombuffer(again, np.uint16)] += 1
    twice = np.flatnonzero(times > 1)
    sparse = len(twice) < BLOCK >> 4
    packed = twice.astype(np.uint16) if sparse else np.packbits(times > 1, bitorder="little")
    return pd.DataFrame({"block": [key[0]], "sparse": [sparse], "packed": [packed.tobytes()]})[: len(twice)]


def seen_twice(texts: DataFrame, least_chars: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """The second Bloom filter over the keys of all texts (column text), as 8-bit numbers."""
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    room = BITS_PER_KEY * chars // max(least_chars, 1)
    bits = min(max(LEAST_BITS, 1 << max(room - 1, 1).bit_length()), most_bits)
    words = np.zeros(bits >> 3, np.uint8)
    hits = texts.select("text").mapInArrow(_hits(least_chars, bits), "block int, once binary, again binary")
    blocks = hits.groupBy("block").applyInPandas(_joined, "block int, sparse boolean, packed binary")
    for row in blocks.toLocalIterator():
        mine = words[row["block"] * (BLOCK >> 3) : (row["block"] + 1) * (BLOCK >> 3)]
        if row["sparse"]:
            at = np.frombuffer(row["packed"], np.uint16)
            np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        else:
            mine |= np.frombuffer(row["packed"], np.uint8)
    return words


def suspected(docs: DataFrame, words: np.ndarray, least_chars: int) -> DataFrame:
    """doc_id, digest: the keys of each document row that the second filter holds, each once a row."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = _keys_of(text, least_chars)
                digests += mine
                ids += [doc] * len(mine)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "digest"])
            yield out.filter(pa.array(holds(shared.value, as_numbers(digests)))) if ids else out

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary")


def _rewrite(least: int, gone_of):
    """The column after doc_id, text and gone becomes n_lines, n_dropped, kept; others stay. gone_of(doc_id, gone): digest -> whether its lines go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                lines, kept, drops = text.count("\n") + 1, None, gone_of(doc, gone)
                if drops is not None:
                    kept = [line for line, d in line_keys(text, least) if d is None or not drops(d)]
                dropped = 0 if kept is None else lines - len(kept)
                for column, value in zip(out, (None if doc == NO_ID else doc, lines, dropped, "\n".join(kept) if dropped else text), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], names=["doc_id", "n_lines", "n_dropped", "kept", *batch.schema.names[3:]])

    return run


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, keep: Sequence[str] = (), most_bits: int = MOST_BITS, held_keys: int = HELD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept and the columns `keep`: every document row without lines that a later document also holds.

    Keys of at least `least_chars` code points found in at least `least_docs` documents lose all their lines, except in
    the largest doc_id that holds one. A null or empty text is one empty line. Documents are told apart by doc_id: rows
    of one doc_id count as one document, and each of them keeps or loses its own lines; a null doc_id counts as the
    smallest. An empty table gives an empty one; columns not in `keep` are left out, whatever their names. A text of any
    length is worked on whole, by one task. At most `held_keys` repeated keys are broadcast; more are joined with the
    documents that hold them.
    """
    spark = docs.sparkSession
    spare = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    found = saved(suspected(spare, seen_twice(spare, least_chars, most_bits), least_chars))
    exact = found.groupBy("digest").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs)
    keys = saved(exact.select("digest", "last"))
    others = [f"keep_{c}" for c in keep]
    if keys.count() <= held_keys:
        shared = spark.sparkContext.broadcast({bytes(r["digest"]): r["last"] for r in keys.collect()})  # held_keys at most

        def gone_of(doc: int, _):
            return lambda d: shared.value.get(d, NO_ID) > doc

        rows = spare.select("doc_id", "text", F.lit(None).cast("binary").alias("gone"), *others)
    else:
        # a key of very many documents is spread over all salts, so that no task has them all
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.distinct().withColumn("salt", salt).join(spread, ["digest", "salt"]).where("doc_id < last")
        drops = hits.groupBy("doc_id").agg(F.array_join(F.transform(F.collect_list("digest"), F.hex), "").alias("gone"))
        rows = spare.join(drops, "doc_id", "left").select("doc_id", "text", F.unhex("gone").alias("gone"), *others)

        def gone_of(_, gone: bytes | None):
            return None if gone is None else {gone[i : i + 16] for i in range(0, len(gone), 16)}.__contains__

    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    out = rows.mapInArrow(_rewrite(least_chars, gone_of), "doc_id long, n_lines long, n_dropped long, kept string" + types)
    return out.select("doc_id", "n_lines", "n_dropped", "kept", *(F.col(f"keep_{c}").alias(c) for c in keep))
