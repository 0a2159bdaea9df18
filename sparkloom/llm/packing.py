"""Best-fit packing with certified bin counts.

Pieces of at most `capacity` tokens are dealt to partitions of bounded size and packed by best-fit decreasing. Each
partition computes a lower bound from dual feasible functions; where the bound meets the bin count, the packing is
proven optimal and stays. A certified partition hands on the pieces of its emptiest bin alone, any other those of all
bins with gaps; what was handed on is dealt anew and packed again, until the bound over all pieces is met or one
partition is left.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import saved

CAPACITY = 2048
#: Pieces in a partition, about; it bounds a task's memory.
PIECES_PER_PARTITION = 20_000
#: Words whose ids a task keeps at most.
CACHE_WORDS = 200_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", row long, sequence_id long, offset long, open boolean"

#: The byte-level vocabulary never joins across a single blank or line end between two other characters, so texts
#: are cut there and the pieces' ids kept by piece.
_CUT = re.compile(r"[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])| ?[^ \t\n\r\x0b\x0c]+|[\t\n\r\x0b\x0c]")
_ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]|<\\|")


#: Fixed value: how the byte-level vocabulary's pre-tokenizer splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words over which every Unicode version classes characters alike, so that the faster encoder gives the same ids.
_PLAIN = re.compile(r"[ \n]?[!-~¡-¬®-ÿ]*")


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary by bytes. Its letters stand for bytes: the printable ones for themselves, the others, in order, for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items() if all(c in byte for c in token)}


class WordIds(dict):
    """Ids by key, encoded when first asked for. Words of other than plain characters go through the tokenizer itself."""

    def __init__(self, tokenizer):
        import tiktoken

        super().__init__()
        self.tokenizer = tokenizer
        ranks = _ranks(tokenizer.get_vocab(with_added_tokens=False))
        self.plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, key: str) -> bytes:
        word = _spelled(key)
        self[key] = ids = array("I", self.plain(word)).tobytes() if _PLAIN.fullmatch(word) else self.whole(word)
        return ids


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a bounded store of the ids of single words."""

    kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.ids = WordIds(Tokenizer.from_file(path))

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, the same as the tokenizer gives for the whole text."""
        look = self.ids.__getitem__
        for text in texts:
            if len(self.ids) > CACHE_WORDS:
                self.ids.clear()
            words = _cut(text)
            yield self.ids.whole(text) if words is None else b"".join(map(look, words))


def _cut(text: str) -> list[str] | None:
    """Keys of the parts of `text` that are encoded on their own; none if it must be encoded as a whole.

    A key is a word that follows a blank, a line end with the word after it, or `\\0` and a part as it stands.
    """
    if _ODD_SPACE.search(text):
        return None
    words = text.replace("\n", " \n").split(" ")
    if "" in words or "\n" in words or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text or "\0" in text:
        return None if "\0" in text else ["\0" + x for x in _CUT.findall(text)]
    words[0] = "\0" + words[0]
    return words


def _spelled(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole sequences, the first one shorter where it doesn't come out even."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize doc_id, text and cut to pieces. A document is its ids and one id 0; a null text is empty, so one id.

    Every row counts, repeated ones and those of a null doc_id too; a text of any length is encoded whole, by one task.
    An empty table gives an empty one; other columns are ignored, whatever their names.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for doc, raw in zip(ids, encoder.batch(texts), strict=True):
                raw += b"\0\0\0\0"
                for k, (start, length) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.ids.clear()  # the worker may serve other stages next

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, as the largest of the bounds by three families of dual feasible functions.

    A dual feasible function maps sizes so that no feasible bin exceeds 1; then the mapped total bounds the bins.
    Used are the identity; for each threshold t the function that rounds sizes over capacity - t up to a whole bin and
    those below t down to none; and the rounding x -> floor((k + 1) x) / k away from multiples of 1 / (k + 1).
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """lower_bound() of pieces given as how many there are of each length."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ sizes) // capacity)
    below = np.concatenate([[0], np.cumsum(counts)])
    mass = np.concatenate([[0], np.cumsum(counts * sizes)])
    t = np.arange(1, capacity // 2 + 1)
    large = below[-1] - below[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled, exact = (k + 1) * sizes // capacity, (k + 1) * sizes % capacity == 0
        # exact multiples keep their size; the values are compared over the common denominator k * capacity
        value = np.where(exact, sizes * k, scaled * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes in falling order: each one's bin, its offset there, and each bin's gap.

    Bins are stacked by gap; a bit per gap says which stacks have bins, so the tightest fit is found at once.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    gaps: list[int] = []
    for i, size in enumerate(lengths.tolist()):
        fitting = filled >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = stacks[gap].pop()
            if not stacks[gap]:
                filled &= ~(1 << gap)
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gap -= size
        gaps[b] = gap
        if gap:
            stacks[gap].append(b)
            filled |= 1 << gap
    return bins, offsets, np.asarray(gaps, np.int64)


def pack_group(group: pa.Table, capacity: int, round_no: int, few: bool) -> pa.Table:
    """Pack one partition's pieces; `open` marks those of the bins to be handed on: the emptiest bin alone of a certified partition or where `few` is asked for, else all bins with gaps."""
    part = group.column("part")[0].as_py()
    group = group.take(pc.sort_indices(group, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")]))
    lengths = group.column("length").to_numpy()
    bins, offsets, gaps = best_fit_decreasing(lengths, capacity)
    again = gaps > 0
    if few or len(gaps) == lower_bound(lengths, capacity):
        again &= np.arange(len(gaps)) == int(gaps.argmax())
    columns = [group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "row")]
    made = [pa.array((round_no << 56) | (part << 28) | bins), pa.array(offsets), pa.array(again[bins])]
    return pa.table([*columns, *made], names=["doc_id", "piece", "start", "length", "ids_crc32", "row", "sequence_id", "offset", "open"])


def _packed(todo: DataFrame, parts: int, round_no: int, capacity: int, few: bool) -> DataFrame:
    """One round: deal the pieces to `parts` partitions by a hash of their row numbers and pack each."""

    def one(group: pa.Table) -> pa.Table:
        return pack_group(group, capacity, round_no, few)

    dealt = todo.withColumn("part", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(one, PLACED_SCHEMA)


def least_sequences(cut: DataFrame, capacity: int) -> int:
    """Sequences that any packing of all pieces needs; Spark counts the lengths, of which there are `capacity` at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return bound_of_counts(counts, capacity)


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Place pieces (PIECE_SCHEMA; other columns are ignored) into sequences of at most `capacity`.

    Returns the pieces with sequence_id (unique numbers, not consecutive) and offset; no sequence has a gap before its
    end. Repeated rows, and those of a null doc_id, are pieces of their own and dealt evenly. Ties are broken by doc_id
    and piece. An empty table gives an empty one. Rounds end when all sequences together are as few as the bound over
    all pieces, or with one partition. After a round that frees fewer sequences than it has partitions, each partition
    hands on its emptiest sequence alone, to half as many partitions at most, until one is left.
    """
    todo, done = saved(cut.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("row", F.monotonically_increasing_id())), []
    bound, finished, before, few = least_sequences(todo, capacity), 0, None, False
    parts, round_no = max(1, -(-todo.count() // per_partition)), 0
    while True:
        now = _packed(todo, parts, round_no, capacity, few)
        if parts > 1:
            now = saved(now)
            first = F.col("offset") == 0
            counts = now.agg(F.count(F.when(first, 1)).alias("all"), F.count(F.when(first & ~F.col("open"), 1)).alias("closed"), F.count(F.when(F.col("open"), 1)).alias("left")).first()
            total = finished + counts["all"]
        if parts == 1 or total == bound or not counts["left"]:
            done.append(now)
            return reduce(DataFrame.unionByName, done).drop("open", "row")
        done.append(now.where("NOT open"))
        todo = now.where("open").select("doc_id", "piece", "start", "length", "ids_crc32", "row")
        few = few or (before is not None and before - total < parts)
        finished, before, round_no = finished + counts["closed"], total, round_no + 1
        needed = max(1, -(-counts["left"] // per_partition))
        parts = min(needed, max(1, parts // 2)) if few else needed
