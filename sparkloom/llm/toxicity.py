"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other evidence is text without labels. With class prior p, positive risk R+
and negative risks R-, the estimate is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): where the second part
falls below nothing, its gradient is turned around, so that the model cannot fit the unlabelled toxic texts as clean.

All texts that may be learned from are unlabelled ones, whatever their number; the positives are a bounded sample of the
toxic labelled rows, which every part of the unlabelled rows is set against.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.sparse import BITS, Adagrad, Model, Rows, annotated, averaged_rounds, bucket_counts, compact_rows, crc_share, sampled, sigmoid, spread, telling

#: Bound of the sample of labelled rows: confirmed toxic texts.
POSITIVES = 20_000
#: Rounds, and steps of a part in a round.
ROUNDS, STEPS = 4, 75


def nnpu_risk(weights: np.ndarray, positive: Rows, unlabelled: Rows, prior: float, scale: np.ndarray) -> tuple[float, float]:
    """The positive and the negative part of the risk of weights (one a feature, each times `scale`, and the bias)."""
    w, bias = weights[:-1] * scale, weights[-1]
    sp, su = sigmoid(positive.dot(w) + bias), sigmoid(unlabelled.dot(w) + bias)
    return -prior * np.log(sp + 1e-12).mean(), -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()


def nnpu_gradient(weights: np.ndarray, positive: Rows, unlabelled: Rows, prior: float, scale: np.ndarray) -> np.ndarray:
    """The gradient of the risk; where the negative part is below nothing, that of the part turned around alone."""
    w, bias = weights[:-1] * scale, weights[-1]
    sp, su = sigmoid(positive.dot(w) + bias), sigmoid(unlabelled.dot(w) + bias)
    sign = 1.0 if -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean() >= 0 else -1.0
    gu = sign * su / len(su)
    gp = (prior * (sp - 1) * (sign > 0) - sign * prior * sp) / len(sp)
    gradient = np.zeros(len(scale))
    positive.add_to(gradient, gp)
    unlabelled.add_to(gradient, gu)
    return np.append(gradient * scale, gu.sum() + gp.sum())


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, positives: int = POSITIVES, rounds: int = ROUNDS, rate: float = 0.2, decay: float = 1e-5, least_z: float = 6.0) -> Model:
    """Fit on about `positives` toxic texts at most and on all texts, of the rows that `may_learn` allows.

    labels: doc_id, toxic; a doc_id labelled more than once counts as toxic if any row says so. The prior is the share of
    toxic among all labelled rows allowed. Only features whose share among toxic and among all texts differs by `least_z`
    standard errors take part, each scaled by its log ratio, so that words met by chance carry no weight. Without toxic
    rows every text gets a score near the prior's floor, 0.001. Rows of a null doc_id are not learned from.
    """
    marked = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marked.agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("p")).first()
    prior = min(max(counts["p"] / max(counts["n"], 1), 0.001), 0.9)
    bias = float(np.log(prior / (1 - prior)))
    ids = sampled(marked.where("toxic = 1").select("doc_id"), positives).withColumn("flag", F.lit(True))
    texts = docs.where(may_learn & F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id", "left").select(F.coalesce("flag", F.lit(False)).alias("flag"), "text")  # `positives` ids
    found = bucket_counts(rows, False)
    ratio = telling(found, least_z) if found.flagged_rows else np.zeros(1 << BITS)
    chosen = np.flatnonzero(ratio)
    if not len(chosen):
        return Model(np.zeros(1 << BITS), bias, False)
    scale = ratio[chosen]
    compact = compact_rows(rows, chosen, found.rows, False)
    toxic = Rows.of([bytes(r["packed"]) for r in compact.where("flag").select("packed").toLocalIterator()])  # `positives` rows of chosen features
    shared = docs.sparkSession.sparkContext.broadcast(toxic)

    def steps(state: np.ndarray, _flags: np.ndarray, unlabelled: Rows, _seed: int) -> np.ndarray:
        model = Adagrad(state, rate, decay)
        for _ in range(STEPS):
            model.step(nnpu_gradient(model.weights, shared.value, unlabelled, prior, scale))
        return model.state

    weights = np.split(averaged_rounds(compact, Adagrad.beginning(np.append(np.zeros(len(chosen)), bias), 1e-4), steps, rounds), 2)[0]
    return Model(spread(chosen, weights[:-1] * scale), float(weights[-1]), False)


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns `keep` for every document row.

    Labels are learned only from rows whose crc32(doc_id as text) mod `parts` is not `held`; those rows have held_out.
    Inputs of a score are the text alone. Null and empty texts get the score of a text without words; a text of any
    length is scored whole. Repeated rows are each scored, and each counts as a text; labels of documents that are not
    there, and null labels, count for nothing. An empty table gives an empty one, and empty labels the score of the
    prior's floor to all. Columns not in `keep` are ignored, whatever their names.
    """
    model = fit(docs, labels, crc_share(F.col("doc_id"), parts) != held)
    return annotated(docs, model, lambda doc_id: crc_share(doc_id, parts) == held, keep)
