import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import facts, report, resolve, rules, scans, sinks
from sparkloom.fixture import Graph

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    made = [(t, i, T0 + dt.timedelta(seconds=s), stage, done, files) for i, (t, s, stage, done, files) in enumerate(rows)]
    return spark.createDataFrame(made, "trace string, event_id long, ts timestamp, stage string, files_done long, files long")


def test_states_of_scans(spark):
    log = events(spark, [
        ("a", 0, "FETCHING", 0, 0), ("a", 5, "ANALYZING", 3, 10), ("a", 7, "ANALYZING", 6, 10), ("a", 20, "COMPLETED", 10, 10), ("a", 30, "FETCHING", 0, 0),
        ("b", 1, "SQL_PARSING", 0, 0), ("c", 2, "FETCHING", 0, 0), ("c", 4, "FAILED", 0, 0), ("d", 9, "ANALYZING", 5, 8), ("e", 9, "WRITING_GRAPH", 0, 0),
    ])
    got = {r["trace"]: r for r in scans.states(log).collect()}
    assert {t: (r["stage"], r["percent"], r["elapsed_ms"]) for t, r in got.items()} == {"a": ("COMPLETED", 100, 20_000), "b": ("SQL_PARSING", 80, 0), "c": ("FAILED", 100, 2_000), "d": ("ANALYZING", 62, 0), "e": ("WRITING_GRAPH", 95, 0)}
    assert [tuple(x) for x in got["a"]["timings"]] == [("FETCHING", 5_000), ("ANALYZING", 13_000)] and got["b"]["timings"] == []
    assert [r["trace"] for r in scans.active(scans.states(log)).collect()] == ["b", "d", "e"]
    assert [r["trace"] for r in scans.ended(scans.states(log)).collect()] == ["c", "a"]
    one = scans.log_of(log, spark.createDataFrame([("a",)], "trace string"))
    assert [r["event"] for r in one.orderBy("ts").collect()] == ["ScanRequested", "CodeFetched", "CodeFetched", "ScanCompleted"]
    assert scans.states(events(spark, [])).count() == 0


def test_runs_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/findings"
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 30)], "id long, rule string, created long")
    for _ in range(2):
        sinks.append_run(rows, path, "one")
    sinks.append_run(spark.createDataFrame([(3, "a", 20)], rows.schema), path, "two")
    found = sinks.history(spark, path)
    assert sorted(r["id"] for r in found.collect()) == [1, 2, 3]
    assert [r["id"] for r in sinks.newest(found, 2).collect()] == [2, 3]
    assert [r["id"] for r in sinks.newest(found, 5, rule="a").collect()] == [3, 1]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "q"), (3, "r")], "id long, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["id"]).collect()} == {(1, "x"), (2, "z"), (3, "r")}
    assert {tuple(r) for r in sinks.upsert(old, new.limit(0), ["id"]).collect()} == {(1, "x"), (2, "y")}


def test_containing(spark):
    frame = lambda name, rows: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    texts, wholes = ["ab", "abcdefgh", "x", "", "zz", "shop.C"], ["zabcdefghz", "abab", "ax", "shop.Controller", "", None]
    got = {tuple(r) for r in resolve.containing(frame("text", texts), frame("whole", wholes)).collect()}
    assert got == {(t, w) for t in texts if t for w in wholes if w and t in w}
    assert resolve.containing(frame("text", []), frame("whole", wholes)).count() == 0


def test_callers_and_targets(spark):
    methods = spark.createDataFrame([(1, "a", "run(int)", "C1", True, "a:C1.run(int)", None), (2, "b", "runAll()", "UserServiceImpl", True, "b:U.runAll()", None), (3, "b", "x()", "UserService", False, "b:U.x()", None)], "method_id long, app_id string, signature string, class_name string, is_entry boolean, full_id string, path string")
    raw = spark.createDataFrame([("c1", "b:U.x()"), ("c2", "z.run(q)"), ("c3", "z.none()")], "call_id string, source string")
    assert {tuple(r) for r in resolve.resolve_callers(raw, methods).collect()} == {("c1", 3, "exact"), ("c2", 1, "prefix")}
    calls = spark.createDataFrame([("c1", 1, "dubboRef.UserService(x)"), ("c2", 2, "dubboRef.UserService(x)")], "call_id string, src long, expression string")
    # an entry of another app whose class contains the name; UserService itself is no entry
    assert [tuple(r) for r in resolve.resolve_external(calls, methods).collect()] == [("c1", 2, "Dubbo")]


def test_rules_by_app_and_registered_ones(spark):
    methods = spark.createDataFrame([(i, i % 2, False, "C", f"m{i}()") for i in range(4)], "method_id long, app_id int, is_entry boolean, class_name string, signature string")
    none = spark.createDataFrame([], "call_id string, src long, dst long, call_type string, line_number int")
    graph = Graph(methods, none, spark.createDataFrame([], "method_id long, table_id int, operation string"))
    assert {r["method_id"] for r in rules.findings(graph, ["orphan-code"], app=1).collect()} == {1, 3}
    before = list(rules.RULES)
    try:
        rules.register(rules.Rule("a-rule", "LOW", "x", lambda g: g.methods.where("method_id = 2"), "T {signature}", "D", "S"))
        assert rules.RULES[0].id == "a-rule" and rules.findings(graph, ["a-rule"]).first()["title"] == "T m2()"
    finally:
        rules.RULES[:] = before


def test_templates_and_apps(spark):
    with pytest.raises(KeyError, match="no template other"):
        report.template("other")
    state = spark.createDataFrame([(1, "t", "c", 1, T0), (2, "u", "c", 2, T0)], "method_id long, table_name string, column_name string, app_id int, last_seen timestamp")
    assert [r["table_name"] for r in facts.table_stats(state, 2).collect()] == ["u"] and facts.table_stats(state, "%").count() == facts.table_stats(state).count() == 2
    document = report.as_document(state.where("method_id = 1").select("table_name", "app_id"), "table_name").first()["document"]
    assert document == '{\n  "table_name" : "t",\n  "app_id" : 1\n}'
    assert sinks.apps_to_scan(spark.createDataFrame([(1,), (2,)], "app_id int"), spark.createDataFrame([(1, True), (2, False)], "app_id int, is_entry boolean")).select(F.collect_list("app_id")).first()[0] == [2]


def test_beginnings_equal_all_pairs(spark):
    """Names that are texts, nest, repeat, are empty or go beyond all texts; texts of other scripts; no names and no texts."""
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abé\U0001f600z") for _ in range(rng.randint(0, 6))) for _ in range(300)] + [None]
    names = ["".join(rng.choice("abé\U0001f600z") for _ in range(rng.randint(0, 3))) for _ in range(60)] + ["zzzzzzzzz", texts[0]]
    held = spark.createDataFrame([(t,) for t in texts], "whole string")
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in resolve.beginnings(wanted, held).collect()]
    assert sorted(got) == sorted((n, t) for n in set(names) if n for t in set(texts) if t is not None and t.startswith(n))
    assert resolve.beginnings(wanted.where("false"), held).count() == 0 == resolve.beginnings(wanted, held.where("false")).count()
