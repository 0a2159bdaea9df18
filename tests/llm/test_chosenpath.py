import random

import numpy as np
import pytest

from sparkloom.llm import chosenpath
from tests.llm.helpers import awkward, frame, words


def by_hand(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links = {i: [j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)}
    out, seen = {}, {}
    for i in range(n):
        todo, group = [i], set()
        while todo:
            u = todo.pop()
            if u not in group:
                group.add(u)
                todo += links[u]
        out[rows[i][0]] = (min(rows[u][0] for u in group), len(links[i]))
    return out


def test_equals_brute_force(spark):
    rows = awkward()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.similarity_classes(frame(spark, rows)).collect()}
    assert got == by_hand(rows)


def test_large_groups_are_split_and_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 80).split()
    rows = []
    for i in range(70):
        near = list(base)
        for _ in range(rng.randint(1, 3)):
            near[rng.randrange(80)] = f"w{rng.randrange(9)}"
        rows.append((i, " ".join(near)))
    monkeypatch.setattr(chosenpath, "SMALL", 8)
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.similarity_classes(frame(spark, rows)).collect()}
    want = by_hand(rows)
    assert sum(got[i][1] for i in want) >= 0.99 * sum(v[1] for v in want.values())
    assert {i: got[i][0] for i in want} == {i: want[i][0] for i in want}


def test_empty_null_ids_and_repeats(spark):
    assert chosenpath.similarity_classes(frame(spark, [])).count() == 0
    got = sorted(map(tuple, chosenpath.similarity_classes(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, None)])).collect()), key=str)
    assert got == [(5, 5, 1), (5, 5, 1), (None, None, 0)]


def test_unlike_texts_of_one_id(spark):
    """Two texts of one doc_id, and two without any, each with a near copy: links and classes go by text."""
    rng = random.Random(21)
    a, b, c, d = (words(rng, 90) for _ in range(4))
    near = lambda text: " ".join(text.split()[:-2] + ["x", "y"])
    rows = [(5, a), (5, b), (8, near(a)), (9, near(b)), (None, c), (None, d), (20, near(c)), (21, near(d)), (5, a.upper()), (30, words(rng, 50))]
    got = sorted(map(tuple, chosenpath.similarity_classes(frame(spark, rows)).collect()), key=str)
    want = [(5, 5, 2), (5, 5, 1), (8, 5, 2), (9, 5, 1), (None, None, 1), (None, None, 1), (20, None, 1), (21, None, 1), (5, 5, 2), (30, 30, 0)]
    assert got == sorted(want, key=str)


def test_runs_reach_the_recall():
    assert chosenpath.runs_for(0.999, 1) == 7 and chosenpath.runs_for(0.999, 3) > 7


def test_few_runs_keep_their_recall(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        text = words(rng, 29).split()  # 25 runs of five words, and the 20 first of them: just the threshold
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:24]))]
    got = chosenpath.similarity_classes(frame(spark, rows), recall=0.9).where("n_links > 0").count()
    assert got >= 0.95 * len(rows)


def test_blocks_of_long_texts_lose_no_link(spark, monkeypatch):
    """The same links where every bucket is cut to blocks of a few sets."""
    docs = frame(spark, awkward())
    want = sorted(map(tuple, chosenpath.similarity_classes(docs).collect()))
    monkeypatch.setattr(chosenpath, "BLOCK_SHINGLES", 150)
    assert sorted(map(tuple, chosenpath.similarity_classes(docs).collect())) == want


@pytest.mark.parametrize("n", [3, 40])
def test_common_counts(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 300, 60).astype(np.uint64)) for _ in range(n)]
    got = chosenpath.common_counts(sets)
    for i in range(n):
        for j in range(i):
            assert got[i, j] == got[j, i] == len(set(sets[i].tolist()) & set(sets[j].tolist()))
