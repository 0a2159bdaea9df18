"""Queries over the whole job of their operators."""

from collections import Counter, defaultdict, deque
from pathlib import Path

import pytest

from sparkloom.fixture import Graph, graph, whole_graph
from sparkloom.operators import drawing, traverse
from sparkloom.plans import registry

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def test_digest_has_findings_of_costly_rules(spark):
    got = registry.queries()["findings_digest_all"](spark, str(FOLDER)).first()
    assert got["n"] == 15 and "[HIGH] Circular dependency" in got["digest"] and "[HIGH] N+1 risk" in got["digest"]


@pytest.fixture(scope="module")
def small(spark):
    g = graph(spark, str(FOLDER))
    apps = {r["method_id"]: r["app_id"] for r in g.methods.collect()}
    calls = sorted((r["call_id"], r["src"], r["dst"], r["call_type"]) for r in g.calls.collect())
    known = [c for c in calls if c[1] in apps and c[2] in apps]
    accesses = [tuple(r) for r in g.accesses.collect()]
    return apps, calls, known, accesses, [r["method_id"] for r in g.methods.where("is_entry").collect()]


def by_queue(small, entry, target=None, most=10, hops=3):
    """Visits and paths of the queue-based trace over all calls, three of them into other apps."""
    apps, _, calls, accesses, _ = small
    queue, seen, visits, paths, crossed = deque([(entry, 0, [])]), set(), [], [], 0
    while queue:
        node, depth, path = queue.popleft()
        path = [*path, node]
        if depth > most:
            continue
        if node == target:
            paths.append((entry, ">".join(map(str, path)), "target"))
            continue
        if node in seen:
            paths.append((entry, ">".join(map(str, path)), "seen"))
            continue
        seen.add(node)
        visits.append((entry, node, depth))
        for _, _, to, kind in (c for c in calls if c[1] == node):
            if kind == "INTERNAL":
                queue.append((to, depth + 1, path))
            elif apps[node] != apps[to] and crossed < hops:
                crossed += 1
                queue.append((to, depth + 1, path))
        paths += [(entry, ">".join(map(str, path)) + f">table:{a[1]}", "table") for a in accesses if a[0] == node]
    return visits, paths


def run(spark, name):
    return sorted(tuple(r) for r in registry.queries()[name](spark, str(FOLDER)).collect())


def test_full_traces_equal_the_queue(spark, small):
    _, calls, _, accesses, entries = small
    visits, paths = (sum(x, []) for x in zip(*(by_queue(small, e) for e in entries), strict=True))
    assert max(v[2] for v in visits) > 3
    assert run(spark, "full_trace_visit") == sorted(visits)
    assert run(spark, "full_trace_paths") == sorted(paths)
    assert run(spark, "full_trace_edges") == sorted((s, c[1], c[2], c[0], c[3]) for s, n, _ in visits for c in calls if c[1] == n)
    assert run(spark, "full_trace_tables") == sorted((s, *a) for s, n, _ in visits for a in accesses if a[0] == n)
    tree = registry.queries()["full_trace_tree"](spark, str(FOLDER)).collect()
    assert sum(r["total_paths"] for r in tree) == len(paths) and all(str(r["seed"]) == r["root"] for r in tree)
    drawn = [r[2] for r in run(spark, "full_trace_graph")]
    assert sum('"subType":"EXTERNAL"' in d for d in drawn) == sum(c[3] == "EXTERNAL" for s, n, _ in visits for c in calls if c[1] == n) > 0


def test_full_traces_to_a_target_equal_the_queue(spark, small):
    want = []
    for e in small[4]:
        target = max((n for _, n, depth in by_queue(small, e)[0] if depth > 0), default=None)
        want += [(s, target, p, end) for s, p, end in by_queue(small, e, target)[1]]
    key = lambda r: (r[0], r[1] or -1, *r[2:])
    assert any(r[3] == "target" for r in want)
    got = [tuple(r) for r in registry.queries()["full_trace_target"](spark, str(FOLDER)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_full_impact_goes_six_calls(spark, small):
    apps, calls, _, accesses, entries = small
    for name, seeds, a, b in (("full_impact", {x[0] for x in accesses if x[2] != "SELECT"}, 2, 1), ("full_impact_downstream", set(entries), 1, 2)):
        want = []
        for seed in seeds:
            seen = near = {seed}
            for _ in range(6):
                near = {c[b] for c in calls if c[a] in near} - seen
                seen = seen | near
            reached = [m for m in seen if m != seed and m in apps]
            if reached:
                want.append((seed, len(reached), sum(m in set(entries) for m in reached)))
        assert run(spark, name) == sorted(want)


def test_impacted_endpoints_name_each_entry_once_a_column(spark):
    got = registry.queries()["impacted_endpoints"](spark, str(FOLDER)).collect()
    assert got and len({tuple(r)[:3] for r in got}) == len(got)


def test_whole_queries_take_every_line_item(spark):
    lines = spark.read.parquet(str(FOLDER / "lineitem.parquet")).count()
    g = whole_graph(spark, str(FOLDER))
    calls, accesses = [tuple(r) for r in g.calls.select("call_id", "src", "dst", "call_type").collect()], [tuple(r) for r in g.accesses.collect()]
    methods = {r["method_id"]: r for r in g.methods.collect()}
    assert len(calls) == len(accesses) == len({c[0] for c in calls}) == lines
    counts = {r["kind"]: r["n"] for r in registry.queries()["whole_graph_counts"](spark, str(FOLDER)).collect()}
    assert (counts["calls"], counts["accesses"]) == (lines, lines)
    out, into, tables = Counter(c[1] for c in calls), Counter(c[2] for c in calls), defaultdict(set)
    for m, t, _ in accesses:
        tables[m].add(t)
    assert run(spark, "whole_degrees") == sorted((m, out[m], into[m]) for m in methods)
    assert [(r[0], r[4]) for r in run(spark, "whole_god_method")] == sorted((m, len(t)) for m, t in tables.items() if len(t) >= 5 and m in methods)
    assert [r[0] for r in run(spark, "whole_orphan_code")] == sorted(m for m, r in methods.items() if not r["is_entry"] and not into[m])
    bad = [a for a in accesses if a[0] in methods and methods[a[0]]["is_entry"] and "Controller" in methods[a[0]]["class_name"]]
    assert sorted((r[0], r[3], r[4]) for r in run(spark, "whole_layer_violation")) == sorted(bad)
    crossing = Counter((methods[c[1]]["app_id"], methods[c[2]]["app_id"]) for c in calls if c[3] == "EXTERNAL" and c[1] in methods and c[2] in methods)
    assert {(r["src_app"], r["dst_app"]): r["n_calls"] for r in registry.queries()["whole_topology"](spark, str(FOLDER)).collect()} == {k: n for k, n in crossing.items() if k[0] != k[1]}
    next_to = defaultdict(set)
    for c in calls:
        next_to[c[1]].add(c[2])
    looping = {m for m in next_to if m in next_to[m] or any(m in next_to[b] or any(m in next_to[c] for c in next_to[b]) for b in next_to[m])}
    assert sorted((r[0], r[3], r[4]) for r in run(spark, "whole_n_plus_one")) == sorted(a for a in accesses if a[0] in looping and a[0] in methods)


def test_traces_through_the_resolver(spark):
    """a.entry calls a.help and, by address, b.serve; a name that nothing has and a fourth hop end in placeholders."""
    import json

    methods = spark.createDataFrame([(1, "a", True, "A", "entry()", "/a", "a:A.entry()"), (2, "a", False, "A", "help()", None, "a:A.help()"), *((10 + i, "b", True, "B", f"serve{i}()", f"/b{i}", f"b:B.serve{i}()") for i in range(4))], "method_id long, app_id string, is_entry boolean, class_name string, signature string, path string, full_id string")
    texts = [("c0", 1, "INTERNAL", "help()"), *((f"c{i + 1}", 1, "EXTERNAL", f'rest.get("http://b/b{i}", x)') for i in range(4)), ("c9", 2, "EXTERNAL", 'rest.get("http://b/none", x)')]
    texts = spark.createDataFrame(texts, "call_id string, src long, call_type string, expression string")
    calls = texts.selectExpr("call_id", "src", "CASE WHEN call_type = 'INTERNAL' THEN 2L ELSE 99L END AS dst", "call_type", "1 AS line_number")
    accesses = spark.createDataFrame([(11, 7, "SELECT")], "method_id long, table_id int, operation string")
    g, found = drawing.through_resolver(Graph(methods, calls, accesses), texts, methods)
    visits, paths, followed = traverse.trace_with_hops(g, methods.where("method_id = 1").select("method_id"))
    assert {r["node"] for r in visits.collect()} == {1, 2, 10, 11, 12}  # three hops into other apps
    assert {r["call_id"] for r in followed.collect()} == {"c1", "c2", "c3"}
    drawn = [(r["part"], r["kind"], json.loads(r["json"])) for r in drawing.draw(g, visits, followed, found).collect()]
    labels = {j["label"] for part, _, j in drawn if part == "node"}
    assert labels == {"A.entry()", "A.help()", "B.serve0()", "B.serve1()", "B.serve2()", "[b] B.serve0()", "[b] B.serve1()", "[b] B.serve2()", "unresolved:call:c4", "unresolved:call:c9", "table:7"}
    assert {j["id"] for part, _, j in drawn if part == "combo"} == {"A", "B", "app:b"}
    assert {j["target"] for part, kind, j in drawn if kind == "CALLS"} == {"2", "10", "11", "12", "call:c4", "call:c9"}
    assert {tuple(j["data"].values()) for part, kind, j in drawn if part == "node" and j["label"] == "A.entry()"} == {("entry()", "", "a", "", 0)}
    more = Graph(methods.selectExpr("*", "'p.q' AS package_name", "'int' AS return_type", "path AS http_path", "7 AS line_number"), g.calls, accesses)
    richer = [(r["part"], json.loads(r["json"])) for r in drawing.draw(more, visits, followed, found).collect()]
    assert {tuple(j["data"].values()) for part, j in richer if part == "node" and j["label"] == "A.entry()"} == {("entry()", "int", "a", "/a", 7)}
    assert {j["id"] for part, j in richer if part == "combo"} == {"p.q.A", "p.q.B", "app:b"}
    flat = drawing.draw(g, visits, followed, found, "method").select("part", "json").collect()
    assert sorted(tuple(r) for r in flat) == sorted((part, r["json"]) for r in drawing.draw(g, visits, followed, found).collect() if (part := r["part"]) != "combo")
    assert [j["style"] for part, kind, j in drawn if kind == "CALLS" and j["target"] == "2"] == [{"stroke": "#666", "lineWidth": 1}]
    raw = drawing.raw(drawing.draw(g, visits, followed, found), paths).first()
    assert len(json.loads(raw["methods"])) == 10 and len(json.loads(raw["calls"])) == 6 and json.loads(raw["paths"]) == [["1", "11", "table:7"]]


def test_calls_at_the_last_depth_are_resolved(spark):
    """At the last depth a call into another app is followed and counted, though its target is not visited."""
    import json

    methods = spark.createDataFrame([(1, "a", True, "A", "m1()", "/a"), (2, "a", False, "A", "m2()", None), *((10 + i, "b", True, "B", f"s{i}()", f"/b{i}") for i in range(4))], "method_id long, app_id string, is_entry boolean, class_name string, signature string, path string")
    texts = spark.createDataFrame([("c0", 1, "INTERNAL", "m2()"), *((f"c{i + 1}", 2, "EXTERNAL", f'rest.get("http://b/b{i}", x)') for i in range(4))], "call_id string, src long, call_type string, expression string")
    calls = texts.selectExpr("call_id", "src", "CASE WHEN call_type = 'INTERNAL' THEN 2L END AS dst", "call_type", "1 AS line_number")
    accesses = spark.createDataFrame([], "method_id long, table_id int, operation string")
    g, found = drawing.through_resolver(Graph(methods, calls, accesses), texts, methods)
    visits, _, followed = traverse.trace_with_hops(g, methods.where("method_id = 1").select("method_id"), most=1)
    assert {(r["node"], r["depth"]) for r in visits.collect()} == {(1, 0), (2, 1)} and {r["call_id"] for r in followed.collect()} == {"c1", "c2", "c3"}
    labels = {json.loads(r["json"])["label"] for r in drawing.draw(g, visits, followed, found).where("part = 'node'").collect()}
    assert labels == {"A.m1()", "A.m2()", "[b] B.s0()", "[b] B.s1()", "[b] B.s2()", "unresolved:call:c4"}


def test_order_of_one_large_seed_over_ranges(spark):
    """Places and crossing calls of a seed that fills several ranges, beside small ones, are as in one sorted list."""
    from pyspark.sql import functions as F

    rows = [(7, i * 37 % 101, f"c{i % 3}{i}", i % 4 == 0) for i in range(400)] + [(s, s % 3, f"d{s}", True) for s in range(20, 40)]
    got, totals = traverse.in_order(spark.createDataFrame(rows, "seed long, parent_rank long, call_id string, crosses boolean"), ["parent_rank", "call_id"])
    want = []
    for seed in {r[0] for r in rows}:
        so_far = 0
        for place, r in enumerate(sorted((r for r in rows if r[0] == seed), key=lambda r: r[1:3])):
            so_far += r[3]
            want.append((*r[:3], place + 1, so_far))
    assert sorted(tuple(r) for r in got.select("seed", "parent_rank", "call_id", "place", "so_far").collect()) == sorted(want)
    assert {r["seed"]: r["total"] for r in totals.collect()} == {s: sum(r[3] for r in rows if r[0] == s) for s in {r[0] for r in rows}}
    assert got.where("seed = 7").select(F.count("*")).first()[0] == 400
