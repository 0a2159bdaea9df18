import re

from pyspark.sql import functions as F

from sparkloom.operators import resolve

METHODS = "method_id long, class_name string, full_id string"


def test_a_class_of_many_pairs_is_made_in_blocks(spark, monkeypatch):
    """All pairs of a class were one key of a join, and all of them were shuffled to be distinct."""
    monkeypatch.setattr(resolve, "CLASS_BLOCK", 10)
    methods = spark.createDataFrame([(i, "A" if i < 90 else None, f"app:A.m{i}()") for i in range(100)] + [(0, "A", "app:A.m0()"), (7, "B", "app:B.m7()")], METHODS)
    wanted = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", None), ("B", "x"), ("C", "x"), (None, "x")], "caller_class string, caller_method string").distinct()
    found = resolve.by_class(wanted, methods)
    got = sorted(map(str, map(tuple, found.collect())))
    assert got == sorted(str((c, m, i)) for c, m, ids in (("A", "x", range(90)), ("A", None, range(90)), ("B", "x", [7])) for i in ids)


def test_pairs_that_several_rules_find_come_once(spark):
    methods = spark.createDataFrame([(1, "A", "app:A.m1()"), (2, "B", "app:B.m1()"), (3, None, "app:C.m1()"), (2, "A", "app:A.z()")], METHODS)
    captured = spark.createDataFrame([("A", "m1()"), ("A", "m1()")], "caller_class string, caller_method string")
    assert sorted(r["method_id"] for r in resolve.accesses_capture(captured, methods).collect()) == [1, 2, 3]


def test_methods_are_not_broadcast(spark):
    """Texts of methods are made of short columns; Spark took them for small and held them all in every executor."""
    methods = spark.range(60).select(F.col("id").alias("method_id"), F.concat(F.lit("C"), F.col("id") % 4).alias("class_name"))
    methods = methods.withColumn("full_id", F.concat(F.lit("app:shop."), "class_name", F.lit(".m"), "method_id", F.lit("()")))
    captured = spark.createDataFrame([("C1", "m5"), ("shop.C2", "m2"), ("C9", "m7()"), ("C9", ""), ("C9", "x"), (None, "m11()"), ("C3", None), ("C0", "m4()")], "caller_class string, caller_method string")
    found = resolve.accesses_capture(captured, methods)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [re.match(r"\[(.*?)\], \[", x)[1] for x in plan.split("BroadcastHashJoin ")[1:]]
    assert "SortMergeJoin" in plan and not [k for k in keys if any(c in k for c in ("method_id", "whole", "caller_method", "block"))]
    rows = [(m, f"C{m % 4}", f"app:shop.C{m % 4}.m{m}()") for m in range(60)]
    want = set()
    for c, name in [tuple(r) for r in captured.collect()]:
        text = ".".join(x for x in (c, name) if x is not None)
        want |= {(c, name, m) for m, own, full in rows if (text and text in full) or (name is not None and full.endswith(name)) or own == c}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
