import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import maxent
from tests.llm.helpers import awkward, frame


def corpus(n=300):
    rng = random.Random(3)
    tongues = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    return [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(60))) for i in range(100, 100 + n)]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus() + awkward() + [(None, "x1 x2"), (9, "repeat"), (9, "repeat")]
    return rows, maxent.score_texts(frame(spark, rows)).collect()


def test_base(scored):
    rows, got = scored
    counts = Counter()
    for doc, text in rows:
        if not held(doc):
            counts.update((text or "").encode().lower().split())
            counts[b""] += 1
    total, size = sum(counts.values()), len(counts)
    log_all = math.log10(total + 0.5 * (size + 1))
    want = []
    for doc, text in rows:
        tokens = [*(text or "").encode().lower().split(), b""]
        want.append((str(doc), held(doc), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(sum(math.log10(counts[t] + 0.5) - log_all for t in tokens), 6)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)


def test_model_learns_what_follows(scored):
    _, got = scored
    rows = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 100 and r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.2 * sum(r["n_tokens"] for r in rows)
    assert all(r["score"] < 0 for r in got)


def test_rare_words_beyond_the_broadcast(spark, monkeypatch):
    rows = corpus(40) + awkward()
    whole = {(r["doc_id"], r["n_known"]): r["base_score"] for r in maxent.score_texts(frame(spark, rows)).collect()}
    monkeypatch.setattr(maxent, "BROADCAST_WORDS", 1100)
    monkeypatch.setattr(maxent, "least_count", lambda counted, most=1100: 3)
    part = {(r["doc_id"], r["n_known"]): r["base_score"] for r in maxent.score_texts(frame(spark, rows)).collect()}
    assert set(whole) == set(part) and all(abs(whole[k] - part[k]) < 1e-6 for k in whole)


def random_weights(seed=0, rows=1 << 10):
    return maxent.Weights(np.random.default_rng(seed).normal(0, 1, maxent.weights_size(rows)).astype(np.float32), rows)


def test_chances_sum_to_one():
    w = random_weights()
    context = np.array([5 * maxent.HISTORIES + 9])
    logits, _ = w.class_logits(context)
    chances, _ = maxent.softmax_parts(logits)
    inner = [maxent.softmax_parts(w.word_logits(context, np.array([g]))[0])[0].sum() for g in range(maxent.OUTPUTS // maxent.IN_CLASS)]
    assert abs(chances.sum() - 1) < 1e-5 and np.allclose(inner, 1, atol=1e-5)
    # the chances of all leaves of a class, one text of two words for each leaf
    history = np.zeros(maxent.OUTPUTS + maxent.OTHERS, np.int64)
    texts = [(np.array([7, maxent.OUTPUTS + 3], np.uint16).tobytes(), np.array([123456, 0xABCD00 + leaf], np.uint32).tobytes()) for leaf in range(maxent.IN_OTHER)]
    with_class = maxent.log_chances(texts, history, w)
    logits, _ = w.class_logits(np.array([maxent.BEGIN * maxent.HISTORIES + history[7]]))
    of_class = logits[0] - np.log(np.exp(logits[0].astype(float)).sum())
    first = maxent.log_chances([(t[:2], m[:4]) for t, m in texts[:1]], history, w)[0]
    assert abs(np.sum(10 ** (with_class - first - of_class[maxent.OUTPUTS // maxent.IN_CLASS + 3] / np.log(10))) - 1) < 1e-4


def test_a_step_follows_the_gradient():
    """The first step of Adagrad has the sign of a finite difference of the mean log chance, for rows of every table."""
    rng = np.random.default_rng(2)
    vocabulary = np.arange(maxent.OUTPUTS + maxent.OTHERS) % maxent.HISTORIES
    docs = [(rng.integers(0, maxent.OUTPUTS + maxent.OTHERS, 30).astype(np.uint16).tobytes(), rng.integers(0, 2**32, 30, dtype=np.uint64).astype(np.uint32).tobytes()) for _ in range(40)]
    w, rows = random_weights(3), 1 << 10
    w.flat *= np.float32(0.3)
    begin = w.flat.copy()
    past = maxent.Weights(np.full(len(begin), 1e-2, np.float32), rows)  # steps so small that they are the gradient, scaled
    maxent.train_on(docs, vocabulary, w, past, 0)
    change = w.flat - begin
    value = lambda flat: maxent.log_chances(docs, vocabulary, maxent.Weights(flat, rows)).sum() * np.log(10) / 1200
    cuts = np.cumsum([maxent.CLASS_ROWS * maxent.CLASSES, maxent.WORD_ROWS * maxent.OUTPUTS, (maxent.OTHERS + rows) * maxent.DIGIT, (maxent.OTHERS * maxent.DIGIT + rows) * maxent.DIGIT])
    for low, high in zip(np.append(0, cuts), cuts, strict=False):
        for at in low + np.argsort(-np.abs(change[low:high]))[:4]:
            step = np.zeros(len(begin), np.float32)
            step[at] = 0.05
            slope = (value(begin + step) - value(begin - step)) / 0.1
            assert abs(change[at] - maxent.RATE * slope / np.sqrt(1e-2 + slope**2)) < 0.1 * abs(change[at])


def test_rows_follow_the_tokens(spark):
    assert [maxent.rows_for(n) for n in (0, 10**6, 10**7, 10**8, 10**12)] == [1 << 10, 1 << 10, 1 << 14, 1 << 17, maxent.MOST_ROWS]
    more = {r["doc_id"]: r["score"] for r in maxent.score_texts(frame(spark, corpus(60)), tokens_per_row=1).collect()}
    assert len(more) == 60 and all(v < 0 for v in more.values())


def test_empty_and_no_training(spark):
    assert maxent.score_texts(frame(spark, [])).count() == 0
    only = next(d for d in range(1, 99) if held(d))
    got = maxent.score_texts(frame(spark, [(only, "a b")])).first()
    assert got["n_known"] == 0 and got["train_tokens"] == 0 and math.isfinite(got["score"])
