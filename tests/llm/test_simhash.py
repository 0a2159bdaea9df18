import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import simhash

from .helpers import awkward, frame, words


def brute(rows):
    """doc_id, n_chars, edited text by the definition; rows of one doc_id must hold one text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    nexts = rows[1:] + rows[:1]
    return sorted((i, len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for (i, t), (_, n) in zip(rows, nexts, strict=True))


@pytest.mark.parametrize("slice_bytes", [40, 1 << 18])
def test_edited_texts(spark, monkeypatch, slice_bytes):
    """Every document meets its next one, over partitions, slices and gaps of ids; equal texts have equal fingerprints."""
    monkeypatch.setattr(simhash, "SLICE_BYTES", slice_bytes)
    rows = [(i * 7 - 40, t) for i, t in awkward()]
    got = simhash.edited_documents(frame(spark, rows).repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == brute(rows)
    texts, own = dict(rows), {}
    for r in got:
        assert own.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == simhash.BITS // 8
    order = sorted(got, key=lambda r: -r["doc_id"])
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        x, y, e = (np.frombuffer(v, np.uint8) for v in (a["fingerprint"], b["fingerprint"], a["edited_fingerprint"]))
        assert a["near_next"] == 1 - np.unpackbits(x ^ y).mean() and a["near_edited"] == 1 - np.unpackbits(x ^ e).mean()
    again = simhash.fingerprint_documents(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in again} == {r["doc_id"]: r["fingerprint"] for r in got}


def test_one_row_repeats_nulls_and_empty(spark):
    one = simhash.edited_documents(frame(spark, [(5, "abcdef")])).collect()
    assert [(r["doc_id"], r["edited"], r["near_next"]) for r in one] == [(5, "abcabc", 1.0)]
    rows = [(4, "x y z"), (4, "x y z"), (4, "other words here"), (None, "p q"), (None, None), (2, None)]
    got = simhash.with_classes(simhash.edited_documents(frame(spark, rows))).collect()
    assert len(got) == 6 and sum(r["doc_id"] is None for r in got) == 2 and {r["n_chars"] for r in got} == {5, 16, 3, 0}
    assert {(r["doc_id"], r["class_id"]) for r in got if r["n_chars"] == 5} == {(4, 4)} and {r["class_id"] for r in got if not r["n_chars"]} == {2}
    assert simhash.with_classes(simhash.edited_documents(frame(spark, rows).where("false"))).count() == 0


def by_definition(text):
    ws = text.lower().split()
    total = np.zeros(simhash.BITS, int)
    for width, weight in simhash.WEIGHTS.items():
        for i in range(len(ws)):
            run = ws[max(0, i - width + 1) : i + 1]
            one = next(iter(simhash.iter_words(pa.array([" ".join(run)]))))
            h = simhash.terms(one, width)[-1:]
            total += weight * simhash.votes(h, np.array([0, 1]))[0]
    return np.packbits(total > 0)


def test_votes_of_long_texts():
    """Sums over bytes and slices equal the votes of each term by itself."""
    rng = random.Random(2)
    texts = [words(rng, 3), "", words(rng, 700), "a " * 400, "One two", None]
    got = simhash.fingerprints(pa.array(texts))
    for text, mark in zip(texts, got, strict=True):
        assert (by_definition(text or "") == mark).all()


def test_half_an_edit_is_nearer_than_another_text():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(30, 300)) for _ in range(200)]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    a, b = simhash.fingerprints(pa.array(texts)), simhash.fingerprints(pa.array(edited))
    near, far = simhash.likeness(a, b), simhash.likeness(a, np.roll(a, -1, axis=0))
    assert (near > far).mean() > 0.98 and near.mean() > 0.64 and abs(far.mean() - 0.5) < 0.03


@pytest.mark.parametrize("bucket,radius", [(4096, 7), (6, 7), (4096, 3), (5, 31)])
def test_block_tables_find_all(spark, monkeypatch, bucket, radius):
    """Classes equal those of all pairs within the radius, also with buckets cut to parts; chains and far fingerprints."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(radius)
    marks = [rng.integers(0, 256, simhash.BITS // 8, dtype=np.uint8) for _ in range(12)]
    for base in marks[:4]:
        last = base
        for step in range(12):
            flips = rng.choice(simhash.BITS, radius + (step % 4 == 3), replace=False)
            bits = np.unpackbits(last if step % 2 else base)
            bits[flips] ^= 1
            marks.append(last := np.packbits(bits))
    rows = [(i + 10, m.tobytes()) for i, m in enumerate(marks)] + [(3, marks[0].tobytes()), (None, marks[1].tobytes())]
    got = simhash.with_classes(spark.createDataFrame(rows, "doc_id long, fingerprint binary"), radius).collect()
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum() <= radius:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None) for g in set(group)}
    assert len(got) == len(rows)
    assert {(r["doc_id"], bytes(r["fingerprint"]), r["class_id"]) for r in got} == {(i, m, least[group[k]]) for k, (i, m) in enumerate(rows)}


def test_query_columns(spark):
    from sparkloom.llm import queries

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op11_fingerprints(spark, folder).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {(i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in brute(texts)} == {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got.values()}
    assert all(len(r["fingerprint"]) == simhash.BITS // 4 and 0 <= r["near_next"] <= 1 for r in got.values())
