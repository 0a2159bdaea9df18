import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import facts
from sparkloom.sources import files, java

ROWS = [("a/b/One.java", "class One {}"), ("a/Two.java", "class Two { int x = 'é'; }"), ("a/test/Three.java", "class Three {}"), ("empty.java", None), ("note.txt", "no java"), ("", "nowhere"), (None, "nowhere")]


@pytest.fixture
def root():
    return "file://" + tempfile.mkdtemp(prefix="spark-files-")


def written(spark, root, rows=ROWS):
    files.write_files(spark.createDataFrame(rows, "path string, content string"), root)


def test_round_trip_and_replacement(spark, root):
    written(spark, root)
    got = {r["path"]: (r["length"], r["content"]) for r in files.read_files(spark, root).collect()}
    assert got.pop("_SUCCESS", None) is None
    assert got == {p: (len((c or "").encode()), c) for p, c in ROWS if p and c}
    assert sorted(r["path"] for r in files.read_files(spark, root, "*.java").collect()) == ["a/Two.java", "a/b/One.java", "a/test/Three.java"]
    written(spark, root, [("a/Two.java", "class Other {}")])
    assert {r["content"] for r in files.read_files(spark, root, "Two.java").collect()} == {"class Other {}"}
    assert not [n for _, _, names in os.walk(root[7:]) for n in names if n.startswith(".") and not n.endswith(".crc")]


def test_bytes_that_are_no_text(spark, root):
    files.write_files(spark.createDataFrame([("x.java", b"class \xff {}")], "path string, content binary"), root)
    assert [r["content"] for r in files.read_files(spark, root).collect()] == ["class � {}"]


def test_tasks_take_a_share_of_the_bytes(spark, root):
    """However the rows were written, files are dealt to tasks by their size."""
    rows = spark.range(40).coalesce(1).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/F"), "id", F.lit(".java")).alias("path"), F.repeat(F.lit("x"), 50_000).alias("content"))
    files.write_files(rows, root)
    keys = {"spark.sql.files.maxPartitionBytes": "200000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        shares = files.read_files(spark, root, "*.java").groupBy(F.spark_partition_id()).agg(F.sum("length").alias("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(shares) >= 10 and max(r["n"] for r in shares) <= 200_000


def test_batches_take_new_files_once(spark, root):
    state, seen = "file://" + tempfile.mkdtemp(prefix="spark-state-"), []

    def each(batch, number):
        seen.append((number, sorted(r["path"] for r in batch.collect())))

    written(spark, root)
    files.scan_batches(spark, root, state, each, "*.java", size=2)
    assert [len(p) for _, p in seen] == [2, 1] and sorted(sum((p for _, p in seen), [])) == ["a/Two.java", "a/b/One.java", "a/test/Three.java"]
    files.scan_batches(spark, root, state, each, "*.java", size=2)
    assert len(seen) == 2
    written(spark, root, [("z/New.java", "class New {}")])
    files.scan_batches(spark, root, state, each, "*.java", size=2)
    assert seen[2:] == [(2, ["z/New.java"])]


def test_a_file_that_nests_too_deeply_costs_itself_alone(spark):
    deep = "class A { int x = " + "new B() { int x = " * 5000 + "1;"
    rows = {r["path"]: r for r in java.scan(spark.createDataFrame([("deep", deep), ("fine", "class C { void m() { f(); } }"), ("none", None)], "path string, content string")).collect()}
    assert rows["deep"]["error"] == "nests too deeply" and rows["deep"]["methods"] == []
    assert rows["fine"]["error"] is None and len(rows["fine"]["methods"]) == 1 and rows["none"]["error"] is None


def test_first_method_of_an_id(spark):
    text = "package p; class C { void m() { a(); }  void k() { } }"
    rows = java.first_of_each(java.methods(spark.createDataFrame([("b", text), ("a", text), ("c", "package q; class C { void m() { b(); } }")], "path string, content string"))).collect()
    assert sorted((r["path"], r["id"]) for r in rows) == [("a", "p.C.k()"), ("a", "p.C.m()"), ("c", "q.C.m()")]


def test_facts_of_relations(spark):
    rows = [("m1", "t", "SELECT", "a,b,a"), ("m1", "t", "SELECT", "b"), ("m2", "t", "INSERT", None), ("m3", "u", "UPDATE", ""), ("mapper:X", "v", "SELECT", "c")]
    got = facts.from_relations(spark.createDataFrame(rows, "source string, table_name string, operation string, columns string")).collect()
    assert sorted(tuple(r) for r in got) == [("m1", "t", "a", "SELECT", 1), ("m1", "t", "b", "SELECT", 2), ("m2", "t", "*", "INSERT", 1), ("m3", "u", "*", "UPDATE", 1)]
