"""Runs of periodically repeated words, found in an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its last square, 2q words, begins
at some word i where the suffixes i and i + q share q words exactly: in the interval of that common length (LCP) the two
lie in different children. So for each interval of length d, and each suffix i of its children but the largest, the
inverse suffix array (ISA) tells whether i + d or i - d is in the interval too. Each such square is rotated to the left as far as
words match, and squares of one stretch are one run, of the smallest period.

Suffix arrays are made for slices of several documents at once, each with an end of its own, by doubling: what ranks
equal by its first 2^k words is ranked by the next 2^k. Ranks of every k are kept; two places match for 2^k words where their ranks
of that k are equal, which gives common lengths to both sides. Intervals come from least values over windows of 2^k. Nothing is
walked node by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a slice, about; a longer document is a slice by itself.
SLICE_WORDS = 1 << 16
#: Suffixes of children that are looked at together.
AT_ONCE = 1 << 20
RUN = "struct<start:long,length:long,period:long>"
OUT = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def word_list(text: Column | str) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def ranked(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each k every place's rank by its first 2^k symbols (equal ones share the least).

    symbols: whole numbers, the last one greater than all others and found once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int64)
    rank = np.empty(n, np.int32)
    rank[order] = _firsts(symbols[order])
    levels, width = [rank], 1
    equal = _repeated(rank[order])
    while len(equal):  # places in `order` whose ranks are shared
        at, rank = order[equal], levels[-1]
        after = np.minimum(at + width, n - 1)
        key = rank[at].astype(np.int64) * n + rank[after]
        turn = np.argsort(key, kind="stable")
        order[equal], key = at[turn], key[turn]
        group = rank[order[equal]]
        inside = np.arange(len(key)) - _firsts(group)  # places of a group follow each other
        new = group + inside[_firsts(key)]
        rank = rank.copy()
        rank[order[equal]] = new
        levels.append(rank)
        equal = equal[_repeated(new)]
        width *= 2
    return order, levels


def _firsts(values: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place of its value."""
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return np.repeat(new, np.diff(np.concatenate([new, [len(values)]])))


def _repeated(values: np.ndarray) -> np.ndarray:
    """Places of a sorted array whose value is there more than once."""
    same = values[1:] == values[:-1]
    return np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes a and b share; a and b differ everywhere."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        out += (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]).astype(np.int64) << k
    return out


def common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols just before the places a < b are the same."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        out += ((x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])).astype(np.int64) << k
    return out


def reaches(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """From each place `at` on in one direction (step 1 or -1), the nearest place whose value is less than that at `at`.

    The array's first and last values must be less than all others between.
    """
    least = [lcp]
    while 2 << (len(least) - 1) <= len(lcp):
        last, half = least[-1], 1 << (len(least) - 1)
        least.append(np.minimum(last[: len(lcp) - 2 * half + 1], last[half : len(lcp) - half + 1]))
    place, value = at.copy(), lcp[at]
    for k in range(len(least) - 1, -1, -1):
        window, size = least[k], 1 << k
        low = place if step > 0 else place - size + 1
        ok = (low >= 0) & (low < len(window))
        ok &= window[np.clip(low, 0, len(window) - 1)] >= value
        place = place + step * size * ok
    return place


def squares(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places i and lengths d where d symbols stand twice in a row from i on, and the next symbol ends that: branching tandem repeats."""
    n = len(order)
    isa = np.empty(n, np.int64)
    isa[order] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)  # lcp[p]: shared by order[p - 1] and order[p]
    lcp[1:n] = common(levels, order[:-1], order[1:])
    border = np.flatnonzero(lcp > 0)
    if not len(border):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = reaches(lcp, border, -1), reaches(lcp, border, 1)  # the interval of a border is low .. high - 1
    sort = np.lexsort((border, lcp[border], low))
    border, low, high = border[sort], low[sort], high[sort]
    depth = lcp[border]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])])  # the first border of each interval
    owner = np.cumsum(new) - 1
    ends = np.concatenate([np.where(new[1:], high[:-1], border[1:]), high[-1:]])
    # children: one before the first border, and one from each border to the next
    of = np.concatenate([owner[new], owner])
    begin, end = np.concatenate([low[new], border]), np.concatenate([border[new], ends])
    sort = np.lexsort((begin - end, of))
    largest = sort[np.concatenate([[True], np.diff(of[sort]) > 0])]
    small = np.ones(len(of), bool)
    small[largest] = False
    of, begin, end = of[small], begin[small], end[small]
    low, high, depth = low[new][of], high[new][of], depth[new][of]
    return _tandem(order, isa, begin, end, low, high, depth)


def _tandem(order: np.ndarray, isa: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The membership test of all suffixes of the children begin .. end - 1 of intervals low .. high - 1."""
    n, sizes = len(order), end - begin
    steps = np.concatenate([[0], np.cumsum(sizes)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(steps, steps[first] + AT_ONCE, "right")) - 1)
        mine = np.repeat(np.arange(first, last), sizes[first:last])
        i = order[np.arange(len(mine)) - np.repeat(steps[first:last] - steps[first], sizes[first:last]) + begin[mine]]
        for sign in (1, -1):
            j = i + sign * depth[mine]
            at = isa[np.clip(j, 0, n - 1)]
            ok = (j >= 0) & (j < n) & (at >= low[mine]) & (at < high[mine]) & ((at < begin[mine]) | (at >= end[mine]))
            found.append((np.minimum(i, j)[ok], depth[mine][ok]))
        first = last
    return np.concatenate([i for i, _ in found]), np.concatenate([d for _, d in found])


def runs(symbols: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs of at least `least` symbols and `times` periods, by start, then period."""
    order, levels = ranked(symbols)
    i, d = squares(order, levels)
    left = common_before(levels, i, i + d)
    keep = left + 2 * d >= least
    start, length, period = (i - left)[keep], (left + 2 * d)[keep], d[keep]
    sort = np.lexsort((period, length, start))
    start, length, period = start[sort], length[sort], period[sort]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # squares of one stretch: the smallest period
    start, length, period = start[new], length[new], period[new]
    keep = length >= times * period
    start, length, period = start[keep], length[keep], period[keep]
    sort = np.lexsort((period, start))
    return start[sort], length[sort], period[sort]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, low = np.concatenate([[0], np.cumsum(sizes)]), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_WORDS, "right")) - 1)
        yield low, high
        low = high


def repeated_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """OUT: for each row, its words, the runs by start then period, and the text without the words that repeat.

    docs: doc_id, text. A run has at least `least` words and `times` periods; words that the first period of a run
    precedes within that run are left out, the others are joined by one space. A null, empty or blank text has no words,
    no runs and an empty text left. Words equal each other byte by byte. Rows are judged each by itself, in the task that
    reads them, repeated rows and those of a null doc_id too. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets, values = column.offsets.to_numpy(), column.values
            for low, high in _slices(np.diff(offsets)):
                words = values.slice(offsets[low], offsets[high] - offsets[low])
                yield _row_batch(batch.column(0).slice(low, high - low), offsets[low : high + 1] - offsets[low], words, least, times)

    return docs.select(F.col("doc_id").cast("long"), word_list("text").alias("words")).mapInArrow(run, OUT)


def _row_batch(ids: pa.Array, first: np.ndarray, words: pa.Array, least: int, times: int) -> pa.RecordBatch:
    n, docs = len(words), len(ids)
    owner = np.repeat(np.arange(docs), np.diff(first))
    coded = words.dictionary_encode()
    symbols = np.empty(n + docs, np.int64)
    symbols[np.arange(n) + owner] = coded.indices.to_numpy()
    symbols[first[1:] + np.arange(docs)] = len(coded.dictionary) + np.arange(docs)  # each document's own end
    start, length, period = runs(symbols, least, times)
    text = np.searchsorted(first[1:] + np.arange(docs), start)  # the document of a run
    start = start - text
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=docs))])
    left = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.filter(pa.array(kept))), " ")
    found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - first[text], length, period)], names=["start", "length", "period"])
    many = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=docs))])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(many, pa.int32()), found), left], names=["doc_id", "n_words", "runs", "collapsed"])
