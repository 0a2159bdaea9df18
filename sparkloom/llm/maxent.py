"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A text is its words (A-Z lower-cased, cut at blanks) and one end. The most frequent words are outputs of their own, in
classes of equal rank ranges; each other word belongs to one of a fixed number of classes by its last two bytes, within
it to one of 256 leaves by two hex digits of its hash, and has within its leaf its smoothed share of the leaf's training
count. So the chance of a word is that of its class given the two words before, times that of the word within the class
or of its two digits given class and words before, times its share of the leaf. Chances of all classes, of the words in
a class and of the digits sum to one; all unknown words of a leaf share one half count.

Features of a history are hashed: the word before, the word before that (a skip), and for classes both. Classes see the
words before as one of 256 symbols; digits see every word as it is, hashed to rows whose number follows the training
tokens, so that what is learned of n-grams grows with the corpus. Training goes in rounds over disjoint shares of the
documents. In each, tasks start from the broadcast weights, take Adagrad steps on their own documents, and return what
changed; Spark averages the changes, weighted by tokens, and the next round goes on from there. Counts are made of all
training tokens by a shuffle; a bounded number of the most frequent words is broadcast with its counts, and all other
words get theirs by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.sparse import crc_share
from sparkloom.llm.words import Words, iter_words, mix
from sparkloom.scratch import saved

#: Words that are outputs of their own, and of those, words in a class.
OUTPUTS, IN_CLASS = 1024, 32
#: Classes of all other words.
OTHERS = 96
CLASSES = OUTPUTS // IN_CLASS + OTHERS
#: History symbols: the most frequent words, then the classes of all others, then the beginning of a text.
OWN_HISTORY = 159
HISTORIES = OWN_HISTORY + OTHERS + 1
BEGIN = HISTORIES - 1
#: Rows of hashed features for classes and for words within classes; row 0 is the bias.
CLASS_ROWS, WORD_ROWS = 4096, 512
#: Digits of a leaf have this many values; leaves of a class, and of all.
DIGIT = 16
IN_OTHER = DIGIT * DIGIT
LEAVES = OTHERS * IN_OTHER
#: Training tokens for a row of hashed features for digits, and the least and most rows of a level (64 MB of weights).
TOKENS_PER_ROW, LEAST_ROWS, MOST_ROWS = 512, 1 << 10, 1 << 20
#: Words whose counts are broadcast (16 bytes each).
BROADCAST_WORDS = 1 << 18
#: Distinct words that a task counts before it passes them on.
COUNTED_AT_ONCE = 300_000
#: Rounds, and steps of a task in a round: as many as keep a step between these numbers of tokens, 16 if both fit.
ROUNDS, STEPS, STEP_TOKENS = 4, 16, (10_000, 16_000)
#: Adagrad's rate, and the squared gradients that each weight is taken to have seen at first.
RATE, START = 0.5, 1e-8
BLOCK, FAN_IN = 4096, 64
#: Training tokens of a task in a round, at least where there are tasks for all cores.
TASK_TOKENS = 20_000_000
#: The hash of the beginning of a text, as a word before others.
BEGIN_MARK = 1
#: Tokens whose scores are computed at once; it bounds a task's memory.
SCORED_AT_ONCE = 400_000
END = b""

_TWO = np.array([zlib.crc32(bytes([a, b])) % OTHERS for a in range(256) for b in range(256)], np.int64)
_ONE = np.array([zlib.crc32(bytes([a])) % OTHERS for a in range(256)], np.int64)


def weights_size(rows: int) -> int:
    return CLASS_ROWS * CLASSES + WORD_ROWS * OUTPUTS + (OTHERS + rows) * DIGIT + (OTHERS * DIGIT + rows) * DIGIT


def rows_for(tokens: int, per_row: int = TOKENS_PER_ROW) -> int:
    """Rows of hashed features of a level of digits: a power of two."""
    return min(max(1 << max(tokens // per_row, 1).bit_length() - 1, LEAST_ROWS), MOST_ROWS)


def groups_of(w: Words) -> np.ndarray:
    """The class of each word if it is no output of its own."""
    low = w.data.copy()
    capital = (low >= 65) & (low <= 90)
    low[capital] += 32
    last = low[w.end - 1].astype(np.int64)
    return np.where(w.end - w.begin > 1, _TWO[low[np.maximum(w.end - 2, 0)].astype(np.int64) * 256 + last], _ONE[last])


def leaves_of(groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return groups * IN_OTHER + (hashes & np.uint64(IN_OTHER - 1)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary, the end as an empty one), c, leaf (-1 of the end): counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update((text or b"").lower().split())
                found[END] += 1
                if len(found) > COUNTED_AT_ONCE:
                    yield out()
                    found = Counter()
        yield out()

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.full(batch.num_rows, -1, np.int64)
            for w in iter_words(batch.column(0)):
                leaf[w.low : w.high][np.diff(w.first) > 0] = leaves_of(groups_of(w), w.hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["word", "c", "leaf"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return counted.mapInArrow(with_leaf, "word binary, c long, leaf long")


def least_count(counted: DataFrame, most: int = BROADCAST_WORDS) -> int:
    """The least count for which at most `most` words have it or more. There are few distinct counts: their number grows with the root of the tokens."""
    by = counted.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most)
    least, seen, above = None, 0, counted.agg(F.coalesce(F.max("c"), F.lit(0))).first()[0] + 1
    for row in by.toLocalIterator():
        seen += row["n"]
        if seen > most:
            break
        least = row["c"]
    return above if least is None else least


@dataclass
class Vocabulary:
    """What is broadcast of the counts: the most frequent words in the order of `keys` (hashes), with rank and count."""

    keys: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    end_count: int
    tokens: int
    log_all: float
    log_leaf: np.ndarray
    history: np.ndarray
    shares: np.ndarray
    leaf_counts: np.ndarray

    @classmethod
    def of(cls, counted: DataFrame) -> "Vocabulary":
        totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        frequent = counted.where((F.length("word") > 0) & (F.col("c") >= least_count(counted))).select("word", "c")
        top = frequent.toPandas().sort_values(["c", "word"], ascending=[False, True])  # BROADCAST_WORDS rows at most
        words, counts = [bytes(w) for w in top["word"]], top["c"].to_numpy(np.int64)
        found = list(iter_words(pa.array(words, pa.binary())))
        hashes = np.concatenate([np.zeros(0, np.uint64), *(w.hashes for w in found)])
        leaf = leaves_of(np.concatenate([np.zeros(0, np.int64), *map(groups_of, found)]), hashes)
        ends = counted.where(F.length("word") == 0).first()
        own = [END, *words[: OUTPUTS - 1]]
        n, v = np.zeros(LEAVES), np.zeros(LEAVES)
        for row in counted.where("leaf >= 0").groupBy("leaf").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # LEAVES rows at most
            n[row["leaf"]], v[row["leaf"]] = row["c"], row["v"]
        np.subtract.at(n, leaf[: OUTPUTS - 1], counts[: OUTPUTS - 1])
        np.subtract.at(v, leaf[: OUTPUTS - 1], 1)
        own_class = np.append(0, leaf[: OUTPUTS - 1] // IN_OTHER)
        history = np.full(OUTPUTS + OTHERS, 0, np.int64)
        history[: len(own)] = OWN_HISTORY + own_class
        history[:OWN_HISTORY] = np.arange(OWN_HISTORY)
        history[OUTPUTS:] = OWN_HISTORY + np.arange(OTHERS)
        own_counts = np.zeros(OUTPUTS)
        own_counts[: len(own)] = [ends["c"] if ends else 0, *counts[: OUTPUTS - 1]]
        shares = np.concatenate([own_counts, n.reshape(OTHERS, IN_OTHER).sum(axis=1)]) + 0.5
        order = np.argsort(hashes)
        return cls(hashes[order], order + 1, counts[order], ends["c"] if ends else 0, totals["n"], float(np.log10(totals["n"] + 0.5 * (totals["v"] + 1))), np.log10(n + 0.5 * (v + 1)), history, shares / shares.sum(), n)


def to_symbols(docs: DataFrame, vocabulary: Vocabulary, held_out: Column) -> DataFrame:
    """Each document as output symbols, with what the broadcast counts say of its tokens, and its other words.

    row, doc_id, held_out, n_tokens, symbols (16-bit), marks (the low 32 bits of each token's hash), known, base, within
    (sums over the tokens with broadcast counts), words, times and leaves (the rest).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for w in iter_words(batch.column(2)):  # a record batch a slice, so that memory does not follow the batch
                out: list[list] = [[] for _ in range(9)]
                at = np.minimum(np.searchsorted(v.keys, w.hashes), max(len(v.keys) - 1, 0))
                hit = v.keys[at] == w.hashes if len(v.keys) else np.zeros(len(w.hashes), bool)
                rank = np.where(hit, v.ranks[at] if len(v.keys) else 0, BROADCAST_WORDS + 1)
                group = groups_of(w)
                leaf = leaves_of(group, w.hashes)
                own = rank < OUTPUTS
                logs = np.where(hit, np.log10((v.counts[at] if len(v.keys) else 0) + 0.5), 0.0)
                base = np.where(hit, logs - v.log_all, 0.0)
                within = np.where(hit & ~own, logs - v.log_leaf[leaf], 0.0)
                symbols = np.insert(np.where(own, rank, OUTPUTS + group), w.first[1:], 0).astype(np.uint16)
                marks = np.insert(w.hashes.astype(np.uint32), w.first[1:], 0)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (hit.astype(np.int64), base, within)]
                count, base_sum, within_sum = (s[w.first[1:]] - s[w.first[:-1]] for s in sums)
                end = np.log10(v.end_count + 0.5) - v.log_all
                ends = w.first + np.arange(len(w.first))
                missing = np.flatnonzero(~hit)
                cut = np.searchsorted(missing, w.first)
                raw = w.data.tobytes().lower() if len(missing) else b""
                for k in range(w.high - w.low):
                    mine = missing[cut[k] : cut[k + 1]]
                    words = [raw[a:b] for a, b in zip(w.begin[mine].tolist(), w.end[mine].tolist(), strict=True)]
                    rest, where = Counter(words), dict(zip(words, leaf[mine].tolist(), strict=True))
                    out[0].append(int(ends[k + 1] - ends[k]))
                    out[1].append(symbols[ends[k] : ends[k + 1]].tobytes())
                    out[2].append(marks[ends[k] : ends[k + 1]].tobytes())
                    out[6].append(list(rest))
                    out[7].append(list(rest.values()))
                    out[8].append([where[x] for x in rest])
                out[3] += (count + (v.end_count > 0)).tolist()
                out[4] += (base_sum + end).tolist()
                out[5] += within_sum.tolist()
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                same = [batch.column(i).slice(w.low, w.high - w.low) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "held_out", "n_tokens", "symbols", "marks", "known", "base", "within", "words", "times", "leaves"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, symbols binary, marks binary, known long, base double, within double, words array<binary>, times array<int>, leaves array<long>")
    return rows.withColumn("row", F.monotonically_increasing_id())


#: A text as bytes: its 16-bit symbols, and the 32-bit marks of its tokens.
Text = tuple[bytes, bytes]


def _before(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The value before each one and the one before that; `begin` where a text begins."""
    one, two = np.empty_like(values), np.empty_like(values)
    one[1:], two[2:] = values[:-1], values[:-2]
    one[starts[sizes > 0]] = two[starts[sizes > 0]] = begin
    two[starts[sizes > 1] + 1] = begin
    return one, two


def histories(docs: list[Text], history: np.ndarray) -> tuple[np.ndarray, ...]:
    """The symbols of all documents, one after the other, the two history symbols before each, and the marks with the two before each; 18 bytes a token."""
    sizes = np.array([len(d) // 2 for d, _ in docs])
    starts = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"".join(d for d, _ in docs), np.uint16)
    marks = np.frombuffer(b"".join(m for _, m in docs), np.uint32)
    return symbols, *_before(history.astype(np.uint16)[symbols], starts, sizes, BEGIN), marks, *_before(marks, starts, sizes, BEGIN_MARK)


def digit_rows(level: int, group: np.ndarray, marks: np.ndarray, one: np.ndarray, two: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The digit of this level (0 or 1) of each word's leaf, and the rows of its features: the class (with the digit before) alone, with the word before, and with the one before that."""
    first = (marks & np.uint32(DIGIT - 1)).astype(np.int64)
    second = ((marks >> np.uint32(4)) & np.uint32(DIGIT - 1)).astype(np.int64)
    node, nodes, digit = (group, OTHERS, first) if not level else (group * DIGIT + first, OTHERS * DIGIT, second)
    salted = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashed = [nodes + (mix((word.astype(np.uint64) + np.uint64(k << 40)) ^ salted) & np.uint64(rows - 1)).astype(np.int64) for k, word in enumerate((one, two))]
    return digit, [node, *hashed]


def feature_rows(context: np.ndarray, rows: int, both: bool) -> list[np.ndarray]:
    """Rows of hashed features of the contexts two * HISTORIES + one."""
    one, two = (context % HISTORIES).astype(np.uint64), (context // HISTORIES).astype(np.uint64)
    found = [one + np.uint64(1 << 20), two + np.uint64(1 << 21)] + ([context.astype(np.uint64) + np.uint64(1 << 30)] if both else [])
    return [(mix(f) % np.uint64(rows - 1)).astype(np.int64) + 1 for f in found]


def softmax_parts(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances, and the logarithm of each row's sum, by row."""
    top = logits.max(axis=1, keepdims=True)
    e = logits - top
    np.exp(e, out=e)
    total = e.sum(axis=1, keepdims=True)
    e /= total
    return e, np.log(total) + top


def _added(table: np.ndarray, out: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    for r in rows:
        out += table[r]
    return out


def _gradient(chances: np.ndarray, place: np.ndarray, outcome: np.ndarray, n: int) -> np.ndarray:
    """By row of chances: how often each outcome was seen at it (place, outcome), less what the chances say, by n; the chances are overwritten."""
    chances *= -np.bincount(place, minlength=len(chances)).astype(np.float32)[:, None]
    np.add.at(chances, (place, outcome), np.float32(1))
    chances /= np.float32(n)
    return chances


class Weights:
    """The tables of a flat array of weights: of classes, of words within classes, and of the two digits of leaves with `rows` hashed rows each."""

    def __init__(self, flat: np.ndarray, rows: int):
        self.flat, self.rows = flat, rows
        cuts = np.cumsum([CLASS_ROWS * CLASSES, WORD_ROWS * OUTPUTS, (OTHERS + rows) * DIGIT])
        classes, words, first, second = np.split(flat, cuts)
        self.classes = classes.reshape(CLASS_ROWS, CLASSES)
        self.words = words.reshape(WORD_ROWS, OUTPUTS // IN_CLASS, IN_CLASS)
        self.digits = [first.reshape(-1, DIGIT), second.reshape(-1, DIGIT)]

    def digit_logits(self, level: int, found: list[np.ndarray]) -> np.ndarray:
        table = self.digits[level]
        return _added(table, table[found[0]], found[1:])

    def class_logits(self, context: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = feature_rows(context, CLASS_ROWS, True)
        return _added(self.classes, self.classes[rows[0]] + self.classes[0], rows[1:]), rows

    def word_logits(self, context: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = feature_rows(context, WORD_ROWS, False)
        return self.words[0, group] + self.words[rows[0], group] + self.words[rows[1], group], rows


def classes_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < OUTPUTS, symbols // IN_CLASS, OUTPUTS // IN_CLASS + symbols - OUTPUTS)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[starts], np.add.reduceat(values[order], starts, axis=0)


def _ascend(table: np.ndarray, past: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    past[rows] += gradient * gradient
    table[rows] += (RATE * gradient / np.sqrt(past[rows])).astype(np.float32)


def train_on(docs: list[Text], history: np.ndarray, w: Weights, past: Weights, seed: int) -> int:
    """Change the weights by steps over these documents; `past` holds Adagrad's sums. Returns the number of tokens."""
    order = np.random.default_rng(seed).permutation(len(docs))
    symbols, one, two, marks, mark_one, mark_two = histories([docs[i] for i in order], history)
    size = min(max(len(symbols) // STEPS, STEP_TOKENS[0]), STEP_TOKENS[1])
    for low in range(0, len(symbols), size):
        part = slice(low, low + size)
        s, n = symbols[part].astype(np.int64), len(symbols[part])
        context, place = np.unique(two[part].astype(np.int64) * HISTORIES + one[part], return_inverse=True)
        logits, rows = w.class_logits(context)
        g = _gradient(softmax_parts(logits)[0], place, classes_of(s), n)
        del logits
        _ascend(w.classes, past.classes, np.array([0]), g.sum(axis=0, keepdims=True))
        for r in rows:
            _ascend(w.classes, past.classes, *_summed(r, g))
        own = s < OUTPUTS
        other = np.flatnonzero(~own)
        for level in (0, 1):
            digit, rows = digit_rows(level, s[other] - OUTPUTS, marks[part][other], mark_one[part][other], mark_two[part][other], w.rows)
            g = _gradient(softmax_parts(w.digit_logits(level, rows))[0], np.arange(len(other)), digit, n)
            for r in rows if len(g) else []:
                _ascend(w.digits[level], past.digits[level], *_summed(r, g))
        pair, at = np.unique(context[place[own]] * (OUTPUTS // IN_CLASS) + s[own] // IN_CLASS, return_inverse=True)
        if not len(pair):
            continue
        group = pair % (OUTPUTS // IN_CLASS)
        logits, rows = w.word_logits(pair // (OUTPUTS // IN_CLASS), group)
        g = _gradient(softmax_parts(logits)[0], at, s[own] % IN_CLASS, n)
        table, old = w.words.reshape(-1, IN_CLASS), past.words.reshape(-1, IN_CLASS)
        for r in (np.zeros(len(pair), np.int64), *rows):
            _ascend(table, old, *_summed(r * (OUTPUTS // IN_CLASS) + group, g))
    return len(symbols)


def texts_of(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[Text]:
    """The texts in the columns from `first`, without holding those of a whole batch as objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            yield from zip(part.column(first).to_pylist(), part.column(first + 1).to_pylist(), strict=True)


def in_parts(texts: Iterator[Text], most: int) -> Iterator[list[Text]]:
    """The texts in lists of about `most` tokens."""
    held, tokens = [], 0
    for text in texts:
        held.append(text)
        tokens += len(text[0]) // 2
        if tokens >= most:
            yield held
            held, tokens = [], 0
    if held:
        yield held


def _averaged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The mean of a block's changes by tokens; tasks send theirs with half precision."""
    total = int(group["tokens"].sum())
    kind = lambda b: np.float16 if len(b) == 2 * BLOCK else np.float32
    change = sum(np.frombuffer(b, kind(b)).astype(np.float64) * n for b, n in zip(group["change"], group["tokens"], strict=True)) / max(total, 1)
    return pd.DataFrame({"block": [key[0]], "task": [key[1]], "tokens": [total], "change": [change.astype(np.float32).tobytes()]})


def prior_weights(vocabulary: Vocabulary, rows: int) -> np.ndarray:
    """Weights by which classes, words and leaves have their training shares, whatever the history."""
    w, own = Weights(np.zeros(weights_size(rows), np.float32), rows), vocabulary.shares[:OUTPUTS].reshape(-1, IN_CLASS)
    w.classes[0] = np.log(np.concatenate([own.sum(axis=1), vocabulary.shares[OUTPUTS:]]))
    w.words[0] = np.log(own / own.sum(axis=1, keepdims=True))
    # a leaf's number is its class, its second digit and its first one
    leaves = vocabulary.leaf_counts.reshape(OTHERS, DIGIT, DIGIT).transpose(0, 2, 1) + 0.5
    first = leaves.sum(axis=2)
    w.digits[0][:OTHERS] = np.log(first / first.sum(axis=1, keepdims=True))
    w.digits[1][: OTHERS * DIGIT] = np.log(leaves / leaves.sum(axis=2, keepdims=True)).reshape(-1, DIGIT)
    return w.flat


def train(texts: DataFrame, vocabulary: Vocabulary, rows: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from doc_id, symbols, marks, beginning at prior_weights(); each round takes the documents of its share by a hash of doc_id."""
    spark, schema, size, history = texts.sparkSession, "block int, task int, tokens long, change binary", weights_size(rows), vocabulary.history
    flat = prior_weights(vocabulary, rows)
    tasks = max(spark.sparkContext.defaultParallelism, -(-vocabulary.tokens // (rounds * TASK_TOKENS)))
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((flat, history))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            start, past = shared.value
            w, sums, tokens = Weights(start.copy(), rows), Weights(np.full(size, START, np.float32), rows), 0
            for docs in in_parts(texts_of(batches, 0), STEPS * STEP_TOKENS[1]):
                tokens += train_on(docs, past, w, sums, number)
            if tokens:
                del sums
                for low in range(0, -(-size // BLOCK), 256):
                    part = slice(low * BLOCK, (low + 256) * BLOCK)
                    some = (w.flat[part] - start[part]).astype(np.float16)
                    some = np.append(some, np.zeros(-len(some) % BLOCK, np.float16)).reshape(-1, BLOCK)
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(range(low, low + n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array([tokens] * n, pa.int64()), pa.array([c.tobytes() for c in some], pa.binary())], names=["block", "task", "tokens", "change"])

        mine = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rounds)) == number).select("symbols", "marks").coalesce(tasks)
        changes, left = mine.mapInArrow(run, schema), tasks
        while True:  # a group holds FAN_IN blocks of 16 KB at most
            changes = changes.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("block", "task").applyInPandas(_averaged, schema)
            left = -(-left // FAN_IN)
            if left <= 1:
                break
        total = np.zeros(size + -size % BLOCK, np.float32)
        for row in changes.toLocalIterator():  # the weights, a block a row
            total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += np.frombuffer(row["change"], np.float32)
        flat = flat + total[:size]
        shared.unpersist()
    return flat


def log_chances(docs: list[Text], history: np.ndarray, w: Weights) -> np.ndarray:
    """By document, the sum of log10 chances of classes, and within them of words that are outputs of their own and of all others' leaves."""
    symbols, one, two, marks, mark_one, mark_two = histories(docs, history)
    symbols, out = symbols.astype(np.int64), np.zeros(len(symbols))
    context, place = np.unique(two.astype(np.int64) * HISTORIES + one, return_inverse=True)
    order = np.argsort(place, kind="stable")
    group = classes_of(symbols)
    for low in range(0, len(context), 16_384):
        part = order[np.searchsorted(place[order], low) : np.searchsorted(place[order], low + 16_384)]
        logits, _ = w.class_logits(context[low : low + 16_384])
        _, total = softmax_parts(logits)
        out[part] = logits[place[part] - low, group[part]] - total[place[part] - low, 0]
    own = np.flatnonzero(symbols < OUTPUTS)
    pair, at = np.unique(context[place[own]] * (OUTPUTS // IN_CLASS) + symbols[own] // IN_CLASS, return_inverse=True)
    if len(pair):
        logits, _ = w.word_logits(pair // (OUTPUTS // IN_CLASS), pair % (OUTPUTS // IN_CLASS))
        _, total = softmax_parts(logits)
        out[own] += logits[at, symbols[own] % IN_CLASS] - total[at, 0]
    others = np.flatnonzero(symbols >= OUTPUTS)
    for low in range(0, len(others), 65_536):
        other = others[low : low + 65_536]
        for level in (0, 1):
            digit, rows = digit_rows(level, symbols[other] - OUTPUTS, marks[other], mark_one[other], mark_two[other], w.rows)
            logits = w.digit_logits(level, rows)
            _, total = softmax_parts(logits)
            out[other] += logits[np.arange(len(other)), digit] - total[:, 0]
    sums = np.concatenate([[0.0], np.cumsum(out)])
    ends = np.concatenate([[0], np.cumsum([len(d) // 2 for d, _ in docs])])
    return (sums[ends[1:]] - sums[ends[:-1]]) / np.log(10)


def score_texts(docs: DataFrame, parts: int = 5, held: int = 1, tokens_per_row: int = TOKENS_PER_ROW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document row.

    Learns from the texts whose crc32(doc_id as text) mod `parts` is not `held`. base_score is the unigram estimate with
    half a count added; score is the model's log10 chance of the text and its end. A null or empty text is its end
    alone; a text of any length is scored whole. Repeated rows are each learned from and scored. Without training texts
    every word has an even chance in its class. An empty table gives an empty one; other columns are ignored, whatever
    their names. The model has a row of hashed features for each `tokens_per_row` training tokens, up to MOST_ROWS.
    """
    held_out = crc_share(F.col("doc_id"), parts) == held
    counted = saved(count_words(docs.where(~held_out)))
    vocabulary = Vocabulary.of(counted)
    texts = saved(to_symbols(docs, vocabulary, held_out))
    rows = rows_for(vocabulary.tokens, tokens_per_row)
    flat = train(texts.where("NOT held_out"), vocabulary, rows, rounds)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((flat, vocabulary.history))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, history = shared.value
        w = Weights(weights, rows)
        for batch in batches:
            scores = []
            for some in in_parts(texts_of([batch], 1), SCORED_AT_ONCE):
                scores += log_chances(some, history, w).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "chance"])

    chances = texts.select("row", "symbols", "marks").mapInArrow(run, "row long, chance double")
    words = texts.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times", "leaves")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"), F.col("x.leaves").alias("leaf"))
    leaves = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(LEAVES), "log_leaf": vocabulary.log_leaf}))  # 24,576 rows
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rest = words.join(F.broadcast(leaves), "leaf").join(counted.select("word", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * (log_c - vocabulary.log_all)).alias("rest_base"),
        F.sum(F.col("times") * (log_c - F.col("log_leaf"))).alias("rest_within"),
    )
    joined = texts.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "within").join(chances, "row").join(rest, "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
        (F.col("chance") + F.col("within") + F.coalesce("rest_within", F.lit(0.0))).alias("score"),
    )
