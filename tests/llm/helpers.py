"""Small tables of documents with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keys string, rep long"


def frame(spark, rows):
    """Documents of (doc_id, text), with extra columns whose names the operators use within."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(seed=3):
    """Nulls, empty and blank texts, a very long one, exact copies, case changes and near copies."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(20, 120)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One  TWO"), (6, words(rng, 5000)), (7, "ä ö ü 你好 \U0001f600 " * 3)]
    for text in base:
        rows.append((len(rows) + 1, text))
    for text in base[:6]:
        rows += [(len(rows) + 1, text), (len(rows) + 2, text.upper())]
    for text in base[6:]:
        parts = text.split()
        for _ in range(4):
            near = list(parts)
            near[rng.randrange(len(near))] = "changed"
            rows.append((len(rows) + 1, " ".join(near)))
    return rows
