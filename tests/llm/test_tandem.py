import hashlib
import random
import zlib
from functools import cmp_to_key

import numpy as np
import pytest

from sparkloom.llm import queries, tandem

from .helpers import awkward, frame


def brute(ws, least, times):
    """All runs of a word list by comparing it with itself at every distance."""
    best, n = {}, len(ws)
    for q in range(1, n // max(times, 1) + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                best.setdefault((i, size), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((i, size, q) for (i, size), q in best.items())


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def collapsed(ws, runs):
    return " ".join(w for i, w in enumerate(ws) if not any(s + q <= i < s + size for s, size, q in runs))


@pytest.mark.parametrize("times", [2, 3])
def test_runs_of_random_words(times):
    """Few symbols, many overlapping runs; the parts of the membership test one by one too."""
    rng = random.Random(times)
    for _ in range(1500):
        ws = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randint(0, 60))]
        if len(ws) > 5 and rng.random() < 0.5:
            a, p = rng.randrange(len(ws)), rng.randint(1, 9)
            ws = [ws[min(a + (i - a) % p, len(ws) - 1)] if i >= a else w for i, w in enumerate(ws)]
        assert list(zip(*(x.tolist() for x in tandem.runs(np.array([*ws, 99]), 6, times)), strict=True)) == brute(ws, 6, times)


def test_suffix_array_and_intervals(monkeypatch):
    monkeypatch.setattr(tandem, "AT_ONCE", 5)
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 90):
        s = np.concatenate([rng.integers(0, 3, n), [5]])
        order, levels = tandem.ranked(s)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        shared = tandem.common(levels, order[:-1], order[1:])
        for a, b, k in zip(order, order[1:], shared, strict=False):
            assert (s[a : a + k] == s[b : b + k]).all() and s[a + k] != s[b + k]
        want = {(i, d) for i in range(n) for d in range(1, n) if i + 2 * d <= n and (s[i : i + d] == s[i + d : i + 2 * d]).all() and s[i + d] != s[i + 2 * d]}
        assert set(zip(*(x.tolist() for x in tandem.squares(order, levels)), strict=True)) == want


@pytest.mark.parametrize("slice_words", [1, 1 << 16])
def test_documents(spark, monkeypatch, slice_words):
    """Copies in one slice, nulls, blanks, long texts, repeated rows, clashing columns; runs end with their document."""
    monkeypatch.setattr(tandem, "SLICE_WORDS", slice_words)
    rng = random.Random(9)
    rows = [(i, t) for i, t in awkward() if len(t or "") < 9000]
    for i in range(60):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        rows.append((100 + i, " ".join(["x"] * (i % 3) + unit * rng.randint(1, 20) + unit[: i % 4]) + (" tail\tz" if i % 2 else "")))
    rows += [(None, "a b " * 15), (100, rows[-1][1]), (100, "a " * 23), (300, "a " * 24), (301, "A a " * 12), (302, "a\x0b\x0ca\n" * 30)]
    got = tandem.repeated_runs(frame(spark, rows).repartition(3)).collect()
    want = []
    for i, text in rows:
        ws = split(text or "")
        runs = brute(ws, 24, 3)
        want.append((str(i), len(ws), runs, collapsed(ws, runs)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)
    assert tandem.repeated_runs(frame(spark, rows).where("false")).count() == 0


def by_contract(doc_id, text):
    ws = split(text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]
    runs = brute(ws, 24, 3)

    def order(x, y):
        return (y[1] * x[2] - x[1] * y[2]) or (x[0] - y[0]) or (x[2] - y[2])

    start, length, period = min(runs, key=cmp_to_key(order)) if runs else (None, None, None)
    digest = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, digest, hashlib.sha256(collapsed(ws, runs).encode()).hexdigest())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r["text"] or "") < 20_000]
    names = {i for i, _ in rows}
    got = queries.op12_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect() if r["doc_id"] in names), key=lambda r: r[0]) == sorted((by_contract(*r) for r in rows), key=lambda r: r[0])
    nulls = queries.with_repeats(frame(spark, [(None, "a b"), (None, None), (0, "")])).collect()
    assert sorted(r["text"] for r in nulls) == ["", "", "a b"]
