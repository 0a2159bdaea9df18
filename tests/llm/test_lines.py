import pytest

from sparkloom.llm import lines
from tests.llm.helpers import frame

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least_chars, least_docs):
    holders = {}
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == doc]
        out[doc] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


def test_equals_brute_force(spark):
    common, other, wide = "This line is on very many of the pages here", "x" * 40, "é" * 40
    rows = [(i, f"start {i}\n  {common.upper() if i % 2 else common}\t\n{other}\nend") for i in range(1, 30)]
    rows += [(30, common + "\n" + common), (31, None), (32, ""), (33, "\n\n"), (34, "é" * 39), (35, "a" * 100_000), (36, f"{common}\x1c")]
    rows += [(40 + i, wide + "\nö") for i in range(4)] + [(50, "É" * 40)]
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == by_hand(rows, 40, 5)
    loose = {r["doc_id"]: tuple(r)[1:] for r in lines.dedup_lines(frame(spark, rows), 3, 2).collect()}
    assert loose == by_hand(rows, 3, 2)


def test_empty_table_and_null_ids(spark):
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    rows = [(None, "y" * 50)] + [(i, "y" * 50) for i in range(5)]
    got = sorted((r["doc_id"] is None, r["n_dropped"]) for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert got == [(False, 0), (False, 1), (False, 1), (False, 1), (False, 1), (True, 1)]


@pytest.mark.parametrize("held", [0, 100])
def test_rows_of_one_document_count_once(spark, held):
    line = "z" * 60
    four = [(1, line)] * 4 + [(2, line)]
    assert {r["n_dropped"] for r in lines.dedup_lines(frame(spark, four), held_keys=held).collect()} == {0}
    five = [(i, f"{line}\nmine {i}") for i in range(1, 6)] + [(2, line), (5, line)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(frame(spark, five), held_keys=held).collect())
    assert got == [(1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 1, 0), (5, 2, 0)]


def test_joined_keys_full_filters_and_other_columns(spark):
    """The same results where keys are joined instead of broadcast and where the filter is so small that it suspects all."""
    common = "a line that stands on many of the pages of this table"
    rows = [(i, f"{common}\nnumber {i} of the lines that stand alone in one document {i}\nend") for i in range(40)] + [(None, common), (99, common), (100, None)]
    docs = frame(spark, rows)
    want = sorted(map(str, lines.dedup_lines(docs).collect()))
    assert sorted(map(str, lines.dedup_lines(docs, held_keys=0).collect())) == want
    assert sorted(map(str, lines.dedup_lines(docs, most_bits=1 << 16).collect())) == want
    kept = lines.dedup_lines(docs, keep=["lang", "digest", "n_chars"])
    assert kept.columns == ["doc_id", "n_lines", "n_dropped", "kept", "lang", "digest", "n_chars"]
    assert {r["n_chars"] for r in kept.where("doc_id = 100").collect()} == {0}


def test_filter_suspects_repeats_alone(spark):
    rows = [(i, f"line number {i} that nobody else has in this table of lines\n" + ("common " * 10 if i % 50 == 0 else "")) for i in range(2000)]
    words = lines.seen_twice(frame(spark, rows), 40)
    found = lines.suspected(frame(spark, rows), words, 40)
    assert 40 <= found.count() <= 60
    digests = [lines.line_keys("common " * 10, 40)[0][1]]
    assert lines.holds(words, lines.as_numbers(digests)).all()
