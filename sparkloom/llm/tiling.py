"""Benchmark decontamination by greedy string tiling.

Runs of five words of the benchmark are the seeds, found in the documents by their rolling (Karp-Rabin) hashes. For a
document and an item that share seeds, seeds on one diagonal are joined to maximal matches; the longest match is marked
again and again, what overlaps it is cut back and tried later, until no match of five unmarked words is left. Marked
tiles neither overlap nor need be in order, so that a reordered passage is still covered. An item is leaked where its
tiles cover at least a given share of its words. Everything happens where the document lies; no text is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.words import Words, iter_words, shingles
from sparkloom.scratch import saved

WIDTH = 5
#: Benchmark words that are sent to the executors at once (16 MB); a larger benchmark takes several passes.
WORDS_IN_BLOCK = 2_000_000
OUT = "doc_id long, item_id long, item_words long, covered long, n_tiles long, longest long"


def tiles(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(begin in item, begin in doc, length) of each tile, longest first; ties to the earlier place in item, then doc."""
    order = np.lexsort((at_item, at_doc - at_item))
    i, d = at_item[order], at_doc[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = ((d - i)[1:] != (d - i)[:-1]) | (i[1:] != i[:-1] + 1)
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(i))) + width - 1
    heap = [(-int(n), int(i[s]), int(d[s])) for s, n in zip(starts, lengths, strict=True)]
    heapq.heapify(heap)
    used_item, used_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(used_item[a : a + n] | used_doc[b : b + n]) & (item[a : a + n] == doc[b : b + n])
        if free.all():
            used_item[a : a + n] = used_doc[b : b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= width:
                heapq.heappush(heap, (lo - hi, a + lo, b + lo))
    return out


class Seeds:
    """Where runs of words occur in a block of items. Items of fewer words than `width` are one run of all of theirs."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.ids = [i for i, _ in items]
        self.words = [np.frombuffer(w, np.uint64) for _, w in items]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                groups.setdefault(min(width, len(w)), []).append(k)
        for n, members in groups.items():
            keys, owner, place = [], [], []
            for k in members:
                runs = run_hashes(self.words[k], n)
                keys.append(runs)
                owner.append(np.full(len(runs), k))
                place.append(np.arange(len(runs)))
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            self.by_width[n] = key[order], np.concatenate(owner)[order], np.concatenate(place)[order]

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(text, item, width, places in item, places in text) for each text of the slice and item with a common run."""
        for n, (key, owner, place) in self.by_width.items():
            runs, starts = shingles(w, n)
            if not len(runs):
                continue
            low, high = np.searchsorted(key, runs, "left"), np.searchsorted(key, runs, "right")
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            many = (high - low)[found]
            at = np.repeat(found, many)
            seed = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[found], many)
            text = np.searchsorted(starts, at, "right") - 1
            order = np.lexsort((owner[seed], text))
            text, item, in_item, in_text = text[order], owner[seed][order], place[seed][order], (at - starts[text])[order]
            cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(text)), strict=True):
                yield int(text[lo]), int(item[lo]), n, in_item[lo:hi], in_text[lo:hi]


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    none = np.zeros(0, np.int64)
    return shingles(Words(0, 1, words, np.array([0, len(words)]), none, none, none, none, none, none), width)[0]


def word_rows(frame: DataFrame, key: str) -> DataFrame:
    """key, words (64-bit numbers as bytes), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [w.hashes[a:b].tobytes() for w in iter_words(batch.column(1)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([len(x) // 8 for x in out], pa.int64())], names=[key, "words", "n"])

    return frame.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, words binary, n long")


def covered_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = WORDS_IN_BLOCK) -> DataFrame:
    """OUT: for every document row and benchmark item with a tile, how many of the item's words the tiles cover.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored, whatever their names. Null and empty texts
    have no words and no tiles; an item of fewer than `width` words has one tile or none. Repeated items count once, rows
    of one doc_id each, a null doc_id or item_id like any other. A text of any length is tiled whole, by one task. Either
    table may be empty.
    """
    items = saved(word_rows(benchmark, "item_id").where("n > 0").distinct())
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    out = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).select("item_id", "words").orderBy("item_id", "words")
        # a block holds about block_words words, so a bounded part of the benchmark
        out.append(_scan(docs, [(r["item_id"], bytes(r["words"])) for r in mine.collect()], width))
    return reduce(DataFrame.unionByName, out)


def _scan(docs: DataFrame, items: list[tuple[int, bytes]], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(shared.value, width)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for w in iter_words(batch.column(1)):
                for text, item, n, in_item, in_text in seeds.hits(w):
                    words = seeds.words[item]
                    found = tiles(words, w.hashes[w.first[text] : w.first[text + 1]], in_item, in_text, n)
                    rows.append((ids[w.low + text], seeds.ids[item], len(words), sum(t[2] for t in found), len(found), found[0][2] if found else 0))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "item_words", "covered", "n_tiles", "longest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, width: int = WIDTH) -> DataFrame:
    """The rows of covered_items() whose tiles cover at least `share` of the item, with `coverage`."""
    found = covered_items(docs, benchmark, width)
    return found.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= share)
