"""Document quality by Bradley-Terry pairwise ranking.

Pairs of a better and a worse labelled document are drawn; the chance that the better one wins is the logistic function
of the difference of their scores, a linear function of hashed words and shape statistics. The scores of the labelled
rows then give the threshold: the quantile below which as many texts lie as are labelled bad.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.sparse import BITS, Adagrad, Model, Rows, annotated, averaged_rounds, bucket_counts, by_part, compact_rows, crc_share, sampled, sigmoid, spread, telling

#: Bound of the sample of labelled rows, by label.
PER_LABEL = 100_000
#: Rounds, how often a part goes over its rows in each, and pairs in a step.
ROUNDS, EPOCHS, PAIRS = 4, 2, 128
#: Steps at which the two labels' scores are compared to find the threshold.
QUANTILES = 1000


def pair_loss(weights: np.ndarray, better: Rows, worse: Rows) -> float:
    """The mean logistic loss of the pairs."""
    return float(-np.log(sigmoid(better.dot(weights) - worse.dot(weights))).mean())


def pair_gradient(weights: np.ndarray, better: Rows, worse: Rows) -> np.ndarray:
    lost = sigmoid(worse.dot(weights) - better.dot(weights)) / len(better)
    gradient = np.zeros(len(weights))
    better.add_to(gradient, -lost)
    worse.add_to(gradient, lost)
    return gradient


def threshold_of(good: np.ndarray, bad: np.ndarray, share_bad: float) -> float:
    """The score below which the share `share_bad` lies of a mixture of that share of bad scores and good ones for the rest; both given by quantiles in equal steps."""
    scores = np.concatenate([good, bad])
    weight = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    order = np.argsort(scores, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(weight[order]), share_bad)), len(order) - 1)
    return float(scores[order[at]] + scores[order[min(at + 1, len(order) - 1)]]) / 2


def _scores(compact: DataFrame, weights: np.ndarray) -> DataFrame:
    shared = compact.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flags, rows in by_part(batches):
            yield pa.RecordBatch.from_arrays([pa.array(flags), pa.array(rows.dot(shared.value))], names=["flag", "score"])

    return compact.mapInArrow(run, "flag boolean, score double")


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = PER_LABEL, rounds: int = ROUNDS, rate: float = 0.05, decay: float = 1e-4, start: float = 1e-6, least_z: float = 3.0) -> Model:
    """Fit on about `per_label` good and as many bad labelled texts at most, of the rows that `may_learn` allows.

    labels: doc_id, quality; a doc_id labelled more than once counts as bad if any row says so. The quantile is the
    share of bad among all labelled rows allowed. Features take part whose share among good and among all these texts
    differs by `least_z` standard errors. With one label alone all texts get that one.
    """
    marked = labels.where(may_learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = marked.agg(F.count("*").alias("n"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad")).first()
    ids = sampled(marked.where("quality = 1"), per_label).unionByName(sampled(marked.where("quality = 0"), per_label))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select((F.col("quality") == 1).alias("flag"), "text")  # 2 * per_label ids
    found = bucket_counts(rows, True)
    if found.flagged_rows in (0, found.rows):
        return Model(np.zeros(1 << BITS), 0.0 if not found.rows else 1.0 if found.flagged_rows else -1.0, True)
    share_bad = counts["bad"] / counts["n"]
    chosen = np.flatnonzero(telling(found, least_z))
    compact = compact_rows(rows, chosen, found.rows, True)

    def steps(state: np.ndarray, flags: np.ndarray, here: Rows, seed: int) -> np.ndarray | None:
        good, bad = np.flatnonzero(flags), np.flatnonzero(~flags)
        if not len(good) or not len(bad):
            return None
        model, draw, n = Adagrad(state, rate, decay), np.random.default_rng(seed), max(len(good), len(bad))
        for _ in range(EPOCHS):
            left, right = good[draw.permutation(n) % len(good)], bad[draw.permutation(n) % len(bad)]
            for a, b in zip(np.array_split(left, max(1, n // PAIRS)), np.array_split(right, max(1, n // PAIRS)), strict=True):
                model.step(pair_gradient(model.weights, here.take(a), here.take(b)))
        return model.state

    weights = np.split(averaged_rounds(compact, Adagrad.beginning(np.zeros(len(chosen)), start), steps, rounds), 2)[0]
    steps_at = [float(x) for x in (np.arange(QUANTILES) + 0.5) / QUANTILES]
    cuts = {r["flag"]: np.array(r["q"]) for r in _scores(compact, weights).groupBy("flag").agg(F.percentile_approx("score", steps_at, F.lit(10 * QUANTILES)).alias("q")).collect()}
    return Model(spread(chosen, weights), -threshold_of(cuts[True], cuts[False], share_bad), True)


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns `keep` for every document row.

    Labels are learned only from rows whose crc32(doc_id as text) mod `parts` is not `held`; those rows have held_out.
    Inputs of a score are the text alone. Null and empty texts get the score of a text without words; a text of any
    length is scored whole. Repeated rows are each scored, and those with a label each learned from; labels of documents
    that are not there, and null labels, count for nothing. An empty table gives an empty one, and empty labels 0.5 to
    all. Columns not in `keep` are ignored, whatever their names.
    """
    model = fit(docs, labels, crc_share(F.col("doc_id"), parts) != held)
    return annotated(docs, model, lambda doc_id: crc_share(doc_id, parts) == held, keep)
