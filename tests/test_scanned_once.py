from pyspark.sql import functions as F

from sparkloom.operators import govern
from sparkloom.sources import java
from sparkloom.sources.javascan import Scanner

TEXT = 'package p;\n// note\nclass C extends B implements I, J {\n  void m() { f(x); new T() { void n() { g(); } }; a::b; }\n}\ninterface K extends L {}'


def files(spark):
    return spark.createDataFrame([("C.java", TEXT, 1), ("D.java", "class D { int n() { return 1; } }", 2)], "path string, content string, app_id int")


def scans(frame):
    """How often the plan reads the files."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_a_file_is_read_once_by_each_query(spark):
    """Links were a union over two scans, metrics a join of texts with a scan, and their sums by app did it twice."""
    links = java.hierarchy(files(spark))
    assert scans(links) == 1
    assert sorted(tuple(r) for r in links.collect()) == [("C", "B", "extends"), ("C", "I", "implements"), ("C", "J", "implements"), ("K", "L", "extends")]
    found = java.metrics(files(spark), "app_id")
    assert scans(found) == 1 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("C.java", 6, 1, 2, 2, 0, 1), ("D.java", 1, 0, 1, 1, 0, 2)]
    methods = spark.createDataFrame([(1, "m"), (1, "m"), (2, "n")], "app_id int, signature string")
    apps = govern.by_app(found, methods)
    assert scans(apps) == 1
    assert sorted(tuple(map(float, r)) for r in apps.collect()) == [(1, 2, 2, 0, 50, 16.7), (2, 1, 1, 0, 0, 0)]


def test_columns_beside_the_content_are_kept(spark):
    rows = java.scan(files(spark).withColumn("tag", F.struct(F.lit("x").alias("a b")))).collect()
    assert sorted((r["path"], r["app_id"], r["tag"][0], len(r["methods"])) for r in rows) == [("C.java", 1, "x", 2), ("D.java", 2, "x", 1)]


def test_declarations_do_not_depend_on_calls():
    whole, bare = Scanner(TEXT), Scanner(TEXT, calls=False)
    assert whole.types == bare.types and bare.methods == [m | {"calls": []} for m in whole.methods] and sum(len(m["calls"]) for m in whole.methods) == 5
