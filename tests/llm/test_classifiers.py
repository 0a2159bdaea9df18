import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import quality, sparse, toxicity
from tests.llm.helpers import awkward, frame, words

BAD = ["scum", "idiot", "worthless", "loser"]


def crc(doc, parts):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % parts


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score double, text string")


def toxic_corpus(n=700):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        text, toxic = words(rng, 60).split(), i % 8 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(BAD)
        rows.append((1000 + i, " ".join(text)))
        labels.append((1000 + i, 1, int(toxic), 0.5, "x"))
    return rows, labels


def test_toxicity_on_held_out(spark):
    rows, labels = toxic_corpus()
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, rows + awkward()), labels_of(spark, labels)).collect()}
    assert len(got) == len(rows) + len(awkward())
    held = [(x[2], got[x[0]]["predicted"]) for x in labels if got[x[0]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and len(held) > 50
    assert all(r["held_out"] == (crc(d, 5) == 0) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] < 0.5


def test_toxicity_never_learns_held_out_labels(spark):
    rows, labels = toxic_corpus(300)
    flipped = [(d, q, (1 - t) if crc(d, 5) == 0 else t, s, x) for d, q, t, s, x in labels]
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame(spark, rows), labels_of(spark, x)).collect()} for x in (labels, flipped))
    assert one == two


def test_quality_on_held_out(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        good = i % 5 > 0
        text = words(rng, 50) if good else " ".join(f"{w}$$$" if i % 2 else "spam" for w in words(rng, 50).split())
        rows.append((i, text))
        labels.append((i, int(good), 0, 0.5, "x"))
    got = {r["doc_id"]: r for r in quality.score_quality(frame(spark, rows), labels_of(spark, labels)).collect()}
    held = [(x[1], got[x[0]]["predicted"]) for x in labels if got[x[0]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and len(held) > 50
    assert all(r["held_out"] == (crc(d, 3) == 1) for d, r in got.items())


def test_no_labels_one_label_null_ids(spark):
    docs = frame(spark, [*awkward(), (None, "x"), (4, "one two")])
    for labels in ([], [(4, 1, 0, 0.1, "x"), (None, 0, 1, 0.1, "x"), (5, None, None, 0.1, "x")]):
        for score in (toxicity.score_toxicity, quality.score_quality):
            got = score(docs, labels_of(spark, labels)).collect()
            assert len(got) == len(awkward()) + 2 and all(0 <= r["score"] <= 1 for r in got)
    empty = frame(spark, [])
    assert toxicity.score_toxicity(empty, labels_of(spark, [])).count() == quality.score_quality(empty, labels_of(spark, [])).count() == 0


def random_rows(rng, n, size):
    return sparse.Rows.of([np.unique(rng.integers(0, size, rng.integers(0, 6))).astype(np.int32).tobytes() for _ in range(n)])


def differences(loss, weights, step=1e-6):
    unit = np.eye(len(weights)) * step
    return np.array([(loss(weights + u) - loss(weights - u)) / (2 * step) for u in unit])


def test_gradients_are_those_of_the_risks():
    rng = np.random.default_rng(4)
    positive, unlabelled, scale = random_rows(rng, 9, 7), random_rows(rng, 20, 7), rng.normal(size=7)
    for prior in (0.1, 0.9):
        for _ in range(5):
            w = rng.normal(size=8)
            plus, minus = toxicity.nnpu_risk(w, positive, unlabelled, prior, scale)
            wanted = (lambda v: sum(toxicity.nnpu_risk(v, positive, unlabelled, prior, scale))) if minus >= 0 else (lambda v: -toxicity.nnpu_risk(v, positive, unlabelled, prior, scale)[1])
            assert np.allclose(toxicity.nnpu_gradient(w, positive, unlabelled, prior, scale), differences(wanted, w), atol=1e-5)
    better, worse, w = random_rows(rng, 12, 7), random_rows(rng, 12, 7), rng.normal(size=7)
    assert np.allclose(quality.pair_gradient(w, better, worse), differences(lambda v: quality.pair_loss(v, better, worse), w), atol=1e-5)


def test_counts_and_averages_equal_those_of_one_task(spark):
    """Bucket counts by Spark equal a plain count, and one part's rounds equal the same steps on the driver."""
    rows = [(i, t) for i, t in enumerate(w for _, w in awkward())]
    texts = frame(spark, rows).select((F.col("doc_id") % 3 == 0).alias("flag"), "text").repartition(5)
    got = sparse.bucket_counts(texts, True)
    flags, everything = np.zeros(1 << sparse.BITS), np.zeros(1 << sparse.BITS)
    for i, text in rows:
        import pyarrow as pa

        (w,) = sparse.iter_words(pa.array([text], pa.string()))
        buckets, _ = sparse.features(w, True)
        everything[buckets] += 1
        flags[buckets] += i % 3 == 0
    assert got.rows == len(rows) and got.flagged_rows == sum(i % 3 == 0 for i, _ in rows)
    assert (got.flagged == flags).all() and (got.all == everything).all()
    chosen = np.flatnonzero(everything >= 2)
    compact = sparse.compact_rows(texts, chosen, got.rows, True)
    assert compact.select("part").distinct().count() == 1

    def steps(state, flag, here, _seed):
        model = sparse.Adagrad(state, 0.1, 0.0)
        for _ in range(3):
            gradient = np.zeros(len(chosen))
            here.add_to(gradient, sparse.sigmoid(here.dot(model.weights)) - flag)
            model.step(gradient / len(here))
        return model.state

    begin = sparse.Adagrad.beginning(np.zeros(len(chosen)), 1e-3)
    found = sparse.averaged_rounds(compact, begin, steps, 2)
    packed = compact.collect()
    alone = (np.array([r["flag"] for r in packed]), sparse.Rows.of([bytes(r["packed"]) for r in packed]))
    want = steps(steps(begin.copy(), *alone, 0), *alone, 0)
    assert np.allclose(found, want)
    spread = sparse.compact_rows(texts, chosen, got.rows, True, rows_in_part=8)
    assert spread.count() == got.rows and spread.select("part").distinct().count() > 2
    assert np.abs(sparse.averaged_rounds(spread, begin, steps, 2) - want)[: len(chosen)].max() < 1


def test_a_bounded_sample_and_kept_columns(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert sparse.sampled(ids, 6000).count() == 5000 and 800 < sparse.sampled(ids, 1000).count() < 1200
    rows, labels = toxic_corpus(80)
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = score(frame(spark, rows), labels_of(spark, labels), keep=["text", "lang", "digest"])
        assert got.columns == ["doc_id", "held_out", "score", "predicted", "text", "lang", "digest"]
        assert {r["doc_id"]: r["text"] for r in got.collect()} == dict(rows)


def test_threshold_is_the_quantile_of_the_mixture():
    good, bad = np.linspace(0, 1, 1001), np.linspace(-1, 0, 1001)
    assert abs(quality.threshold_of(good, bad, 0.3)) < 0.01
    assert abs(quality.threshold_of(good, good, 0.25) - 0.25) < 0.01
