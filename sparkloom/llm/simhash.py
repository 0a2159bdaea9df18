"""SimHash fingerprints of texts, and block tables that find those within a Hamming radius.

A term is a run of two or of three words, ending at each word of the text; before the first word stand blanks. Every
term's hash is spread to 256 bits, and each occurrence votes with its weight for or against each bit, so a term's weight
in a text is its count times that of its width. The fingerprint holds the bits with more votes for than against. The
share of equal bits of two fingerprints estimates the angle between the two texts' weighted terms.

Fingerprints within radius r, cut to r + 1 blocks, agree on one block at least. There is a table for each block, with
that block moved to the front as its key, and only fingerprints that share a key are compared, all of them. Equal
fingerprints are one entry of a table. Buckets of many entries are cut to parts, and each two parts are a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.words import SLICE_BYTES, Words, iter_words, mix
from sparkloom.scratch import saved

#: Bits of a fingerprint (a multiple of 64), the weight of terms by their words, and the radius that near texts lie in.
BITS, WEIGHTS, RADIUS = 256, {2: 1, 3: 1}, 7
#: Terms that are spread to bits at once, and of those that are summed in one byte a bit (at most 255).
TERMS_AT_ONCE, TERMS_A_BYTE = 1 << 14, 128
#: Keys per partition that place its bounds; they and the bounds are all that the driver holds of the documents.
KEYS_A_PARTITION = 64
#: Entries of a bucket that one task compares with each other.
BUCKET = 4096
#: Fingerprints that more than this share of all documents have are joined by a broadcast, of 1 / HOT_SHARE rows at most.
HOT_SHARE = 0.001
_LANES = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(BITS // 64)]
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(max(WEIGHTS))]
OUT = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def terms(words: Words, width: int) -> np.ndarray:
    """For every word, a number for the `width` words that end with it; blanks before the text's first word are 0."""
    place = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], np.diff(words.first))
    out = words.hashes * _STEP[0]
    for back in range(1, width):
        out[back:] += np.where(place[back:] >= back, words.hashes[:-back], np.uint64(0)) * _STEP[back]
    return mix(out + np.uint64(width))


def votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text and bit, the terms for it less those against it. first: where each text's terms begin, and the end."""
    out, n = np.zeros((len(first) - 1, BITS), np.int64), len(hashes)
    begins = np.unique(np.concatenate([first[:-1][np.diff(first) > 0], np.arange(0, n, TERMS_A_BYTE)])).astype(np.int64)
    for low in range(0, n, TERMS_AT_ONCE):
        part = hashes[low : low + TERMS_AT_ONCE]
        spread = np.stack([mix(part ^ lane) for lane in _LANES], axis=1)
        ones = np.unpackbits(spread.view(np.uint8), axis=1).view(np.uint64)  # a byte a bit, added eight at a time
        mine = begins[np.searchsorted(begins, low) : np.searchsorted(begins, low + TERMS_AT_ONCE)]
        sums = np.add.reduceat(ones, mine - low, axis=0).view(np.uint8)
        owner = np.searchsorted(first, mine, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0]))
        out[owner[new]] += np.add.reduceat(sums, new, axis=0, dtype=np.int64)
    return 2 * out - np.diff(first)[:, None]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of every text as a row of BITS / 8 bytes; a text without words, or null, has no bit set."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for words in iter_words(texts):
        total = sum(weight * votes(terms(words, width), words.first) for width, weight in WEIGHTS.items())
        out[words.low : words.high] = np.packbits(total > 0, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of each two fingerprints."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (binary): one row per row of `docs` (doc_id, text); a null text is empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(fingerprints(batch.column(1)))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars and the order of documents: `at`, falling doc_id (null last), then `tie`, by the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.when(F.col("doc_id").isNull(), F.lit(2**63 - 1)).otherwise(F.bitwise_not(F.col("doc_id").cast("long")))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"at": at, "tie": F.xxhash64("text")})


def _dealt(docs: DataFrame) -> DataFrame:
    """part, head, doc_id, text: documents in ranges of their order, each range sorted, and after it (head = 1) the first document of the next range, after the last that of the first."""
    spark, rows = docs.sparkSession, _keys(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, rows.count() // (parts * KEYS_A_PARTITION))
    some = rows.where(F.pmod(F.xxhash64("at", "tie"), F.lit(every)) == 0).select("at", "tie").distinct()
    keys = sorted(map(tuple, some.collect()))  # KEYS_A_PARTITION a partition, about
    cuts = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    pairs = F.arrays_zip(*(F.lit([c[i] for c in cuts]).cast("array<long>") for i in (0, 1)))
    rows = rows.withColumn("part", F.size(F.filter(pairs, lambda c: (c["0"] < F.col("at")) | ((c["0"] == F.col("at")) & (c["1"] <= F.col("tie"))))))
    heads = sorted(map(tuple, rows.groupBy("part").agg(F.min(F.struct("at", "tie")).alias("k")).select("part", "k.at", "k.tie").collect()))  # one a partition
    before = [(heads[i - 1][0], at, tie) for i, (_, at, tie) in enumerate(heads)]
    held = spark.createDataFrame(before, "before int, at long, tie long")
    rows = rows.join(F.broadcast(held), ["at", "tie"], "left")
    to = F.array_compact(F.array(F.struct("part", F.lit(0).alias("head")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("head")))))
    spread = rows.select("doc_id", "text", "at", "tie", F.explode(to).alias("to")).select("to.part", "to.head", "doc_id", "text", "at", "tie")
    return spread.repartition(parts, "part").sortWithinPartitions("part", "head", "at", "tie", "text").select("part", "head", "doc_id", "text")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one part in order, in lists of about SLICE_BYTES; each ends with the row that the next list begins with, or a head."""
    held, chars = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[-1][1] and (row[1] or row[0] != held[-1][0]):  # heads beyond the first are copies of it
                if row[1] and row[0] == held[-1][0]:
                    continue
                yield held
                held, chars = [], 0
            elif chars > SLICE_BYTES and len(held) > 1:
                yield held
                held = held[-1:]
                chars = len(held[0][3])
            held.append(row)
            chars += len(row[3])
    if held:
        yield held


def edited_documents(docs: DataFrame) -> DataFrame:
    """OUT: each document, its edited text, and the fingerprints of both and of the next document.

    The next document is that of the next smaller doc_id, after the last the first; a table of one document has that as
    its own next. The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the
    next. docs: doc_id, text. A null text is empty. Rows of one doc_id follow each other by a hash of their texts, those
    of a null doc_id come last. Other columns are ignored. An empty table gives an empty result. Texts are shuffled once,
    to ranges of doc_id; the first document of a range goes to the one before it too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for rows in _slices(batches):
            texts = [r[3] for r in rows]
            edited = pa.array([a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)], pa.string())
            known = last is not None and last[0] is rows[0]
            own = fingerprints(pa.array(texts[known:], pa.large_string()))
            own = np.concatenate([last[1][None], own]) if known else own
            last, other = (rows[-1], own[-1]), fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in rows[:-1]], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()), edited, _binary(own[:-1]), _binary(other)]
                + [pa.array(likeness(own[:-1], x), pa.float64()) for x in (other, own[1:])],
                names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return _dealt(docs).mapInArrow(run, OUT)


def block_keys(marks: np.ndarray, radius: int) -> list[list[bytes]]:
    """For each of the radius + 1 tables, the keys of all fingerprints: the table's number and its block of bits."""
    bits, cuts = np.unpackbits(marks, axis=1), [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [[bytes([t]) + row.tobytes() for row in np.packbits(bits[:, low:high], axis=1)] for t, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))]


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius, as few as connect what all of them connect, found by walks.

    Between the rows of `left`, or, with `right`, between rows of one and of the other; numbers of `right` follow those
    of `left`. A walk goes from a row to all rows not yet reached, so a group of n copies of one text takes n comparisons.
    """
    marks = (left if right is None else np.concatenate([left, right])).view(np.uint64)
    side = np.arange(len(marks)) >= len(left)
    rest, out = np.ones(len(marks), bool), []
    for start in range(len(marks)):
        if not rest[start]:
            continue
        rest[start], queue = False, [start]
        while queue:
            i = queue.pop()
            others = np.flatnonzero(rest if right is None else rest & (side != side[i]))
            near = others[np.bitwise_count(marks[others] ^ marks[i]).sum(axis=1) <= radius]
            rest[near] = False
            queue += near.tolist()
            out += [(i, j) for j in near.tolist()]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _links_of(radius: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        mark = lambda part: np.frombuffer(b"".join(part["fingerprint"]), np.uint8).reshape(-1, BITS // 8)
        if key[1] == key[2]:
            both, (a, b) = group, spanning_links(mark(group), None, radius)
        else:
            first = group["part"] == key[1]
            both = pd.concat([group[first], group[~first]])
            a, b = spanning_links(mark(group[first]), mark(group[~first]), radius)
        names = both["fingerprint"].to_numpy()
        return pd.DataFrame({"u": names[a], "v": names[b]})

    return run


def near_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links between distinct fingerprints of `marks` (fingerprint) within the radius, that connect all that such links connect.

    Each bucket of a table of up to BUCKET entries is one task's work; of a larger one each two parts are.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for keys in block_keys(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8), radius):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), column], names=["key", "fingerprint"])

    tables = marks.select("fingerprint").mapInArrow(keyed, "key binary, fingerprint binary")
    shared = tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BUCKET).cast("int")
    rows = tables.join(shared, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiles = rows.select("key", "fingerprint", "part", other).select("key", "fingerprint", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return tiles.groupBy("key", "i", "j").applyInPandas(_links_of(radius), "u binary, v binary")


def with_classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`rows` (doc_id, fingerprint, ...) with class_id: the least doc_id of all rows that links within the radius connect with this one.

    Rows of equal fingerprints are one entry; a class of rows without doc_id alone has a null class_id.
    """
    marks = saved(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(near_links(marks, radius)).select(F.col("node").alias("fingerprint"), "component")
    named = found.join(marks, "fingerprint")
    least = named.groupBy("component").agg(F.min("least").alias("class_least"))
    linked = named.join(least, "component").select("fingerprint", "class_least")
    classes = marks.join(linked, "fingerprint", "left").select("fingerprint", "n", F.coalesce("class_least", "least").alias("class_id"))
    classes = saved(classes)
    many = F.lit(HOT_SHARE * rows.count())
    hot = classes.where(F.col("n") > many).select("fingerprint", "class_id")
    cold = classes.where(F.col("n") <= many).select("fingerprint", "class_id")
    return rows.join(F.broadcast(hot), "fingerprint").unionByName(rows.join(F.broadcast(hot), "fingerprint", "left_anti").join(cold, "fingerprint"))
