import random

import numpy as np

from sparkloom.llm import tiling
from tests.llm.helpers import awkward, frame, words


def by_hand(item, doc, width):
    """Greedy string tiling as first described: scan all pairs for the longest unmarked match, mark it, again."""
    used_i, used_d, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= width and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return out
        n, i, d = -best[0], best[1], best[2]
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))
        out.append((i, d, n))


def test_tiles_equal_the_greedy_scan():
    rng = random.Random(4)
    for _ in range(80):
        item = np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 25))], np.uint64)
        doc = np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 40))], np.uint64)
        hits = [(i, d) for i in range(len(item) - 2) for d in range(len(doc) - 2) if (item[i : i + 3] == doc[d : d + 3]).all()]
        at = np.array(hits or np.zeros((0, 2)), int)
        assert tiling.tiles(item, doc, at[:, 0], at[:, 1], 3) == by_hand(item.tolist(), doc.tolist(), 3)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark):
    rng = random.Random(6)
    item = words(rng, 40).split()
    whole, part = " ".join(item), " ".join(item[:12])
    mixed = " ".join(item[20:40]) + " and then " + " ".join(item[:20])
    docs = frame(spark, [(1, words(rng, 200) + " " + whole.upper() + " " + words(rng, 50)), (2, mixed), (3, part), (4, words(rng, 300)), (5, None), (6, "tiny item"), *[(i + 10, t) for i, t in awkward()]])
    items = bench(spark, [(7, whole), (8, "tiny item"), (9, None), (10, ""), (7, whole)])
    got = sorted((r["doc_id"], r["item_id"], r["n_tiles"], round(r["coverage"], 2)) for r in tiling.leaks(docs, items).collect())
    assert got == [(1, 7, 1, 1.0), (2, 7, 2, 1.0), (6, 8, 1, 1.0)]
    blocks = sorted((r["doc_id"], r["item_id"]) for r in tiling.covered_items(docs, items, block_words=10).where("covered * 2 >= item_words").collect())
    assert blocks == [(1, 7), (2, 7), (6, 8)]


def test_empty_tables(spark):
    assert tiling.leaks(frame(spark, []), bench(spark, [(1, "a b c d e")])).count() == 0
    assert tiling.leaks(frame(spark, awkward()), bench(spark, [])).count() == 0


def test_long_repeated_and_clashing_rows(spark):
    """A very long text, rows of one doc_id, null ids, and a benchmark whose other columns have the operator's own names."""
    rng = random.Random(8)
    item = words(rng, 30)
    long = words(rng, 60_000) + " " + item + " " + words(rng, 60_000)
    items = spark.createDataFrame([(1, item, 5, "x", 0.5), (None, item, 6, "y", 0.1)], "item_id long, text string, n long, words string, coverage double")
    got = sorted(((r["doc_id"], r["item_id"]) for r in tiling.leaks(frame(spark, [(1, long), (2, item), (2, item), (None, item), (3, item[:20])]), items).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 2, 2, None) for i in (1, None)], key=str)
