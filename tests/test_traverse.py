import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sparkloom.fixture import Graph
from sparkloom.operators import bitreach, blockreach, edgefiles, returns, rules, traverse


def graph_of(spark, calls, accesses=(), methods=None):
    known = methods or sorted({m for c in calls for m in c[1:3]} | {a[0] for a in accesses})
    rows = [(m, 0, m == 1, "C", f"m{m}()") if isinstance(m, int) else m for m in known]
    return Graph(
        spark.createDataFrame(rows, "method_id long, app_id int, is_entry boolean, class_name string, signature string"),
        spark.createDataFrame([(c[0], c[1], c[2], c[3] if len(c) > 3 else "INTERNAL", 1) for c in calls], "call_id string, src long, dst long, call_type string, line_number int"),
        spark.createDataFrame(list(accesses), "method_id long, table_id int, operation string"),
    )


def by_hand(calls, accesses, entry, most, target=None):
    """The queue-based trace that the operator must equal."""
    queue, seen, visits, paths = deque([(entry, 0, [])]), set(), [], []
    while queue:
        node, depth, path = queue.popleft()
        path = [*path, node]
        if depth > most:
            continue
        if node == target:
            paths.append((">".join(map(str, path)), "target"))
            continue
        if node in seen:
            paths.append((">".join(map(str, path)), "seen"))
            continue
        seen.add(node)
        visits.append((node, depth))
        for c in sorted(c for c in calls if c[1] == node):
            queue.append((c[2], depth + 1, path))
        for a in accesses:
            if a[0] == node:
                paths.append((">".join(map(str, path)) + f">table:{a[1]}", "table"))
    return sorted(visits), sorted(paths)


CALLS = [("a", 1, 2), ("b", 1, 3), ("c", 2, 4), ("d", 3, 4), ("e", 4, 1), ("f", 4, 5), ("g", 5, 5), ("h", 2, 4)]
ACCESSES = [(4, 7, "SELECT"), (4, 7, "UPDATE"), (5, 8, "DELETE")]


@pytest.mark.parametrize(("most", "target"), [(1, None), (2, None), (6, None), (6, 4)])
def test_trace_equals_the_queue(spark, most, target):
    g = graph_of(spark, CALLS, ACCESSES)
    entries = g.methods.where("is_entry").select("method_id")
    goal = spark.createDataFrame([(1, target)], "seed long, target long") if target else None
    visits, paths = traverse.trace(g, entries, most, goal)
    want = by_hand(CALLS, ACCESSES, 1, most, target)
    assert sorted((r["node"], r["depth"]) for r in visits.collect()) == want[0]
    assert sorted((">".join(r["path"]), r["end"]) for r in paths.collect()) == want[1]


def test_hops_into_other_apps_are_capped(spark):
    methods = [(m, m % 2 if m < 2 else m, m == 1, "C", f"m{m}()") for m in range(1, 7)]
    calls = [(f"c{m}", 1, m, "EXTERNAL") for m in range(2, 7)]
    g = graph_of(spark, calls, (), methods)
    visits, _ = traverse.trace(g, g.methods.where("is_entry").select("method_id"), 3, hops=3)
    assert sorted(r["node"] for r in visits.collect()) == [1, 2, 3, 4]


def test_closed_trails_use_each_call_once(spark):
    g = graph_of(spark, [("a", 1, 2), ("b", 2, 1), ("c", 2, 3), ("d", 3, 1), ("e", 9, 1)])
    got = sorted((r["start"], r["cycle"], r["depth"]) for r in traverse.closed_trails(g.calls, 2, 5).collect())
    assert (1, "1>2>1", 2) in got and (3, "3>1>2>3", 3) in got and not [x for x in got if x[0] == 9]
    assert traverse.closed_trails(g.calls.where("false"), 2, 3).count() == 0


def test_cycles_and_reach(spark):
    g = graph_of(spark, [("a", 1, 2), ("b", 2, 3), ("c", 3, 1), ("d", 3, 4), ("e", 4, 4)])
    assert {r[0] for r in traverse.on_cycle(g.calls, 3).collect()} == {1, 2, 3, 4}
    assert {r[0] for r in traverse.on_cycle(g.calls, 2).collect()} == {4}
    edges = g.calls.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = traverse.reach(spark.createDataFrame([(1,)], "method_id long"), edges, 2)
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(1, 0), (2, 1), (3, 2)}


def test_endpoints_are_named_by_the_method_of_most_accesses(spark):
    g = graph_of(spark, [("a", 1, 2), ("b", 1, 3), ("c", 2, 4)])
    facts = spark.createDataFrame([("t", "c", 2, 5), ("t", "c", 3, 9), ("t", "c", 4, 9), ("t", "d", 4, 1), ("t", "e", 1, 1)], "table_name string, column_name string, method_id long, access_count long")
    got = sorted(tuple(r) for r in traverse.impacted_endpoints(g, facts).collect())
    assert got == [("t", "c", 1, 3, 1), ("t", "d", 1, 4, 2)]


def distances(calls, seed):
    """Each method's least number of calls from the seed."""
    near, queue = {seed: 0}, deque([seed])
    while queue:
        at = queue.popleft()
        for c in calls:
            if c[1] == at and c[2] not in near:
                near[c[2]] = near[at] + 1
                queue.append(c[2])
    return near


@pytest.mark.parametrize("together", [4096, 30])
def test_reach_of_many_seeds_equals_walks_of_each(spark, monkeypatch, together):
    """More seeds than one block holds, dense and sparse parts, seeds without calls and unknown ones; counts, entries and depths."""
    monkeypatch.setattr(bitreach, "NUMBERED_AT_ONCE", together)
    rng = random.Random(together)
    calls = [(f"c{i}", rng.randrange(90), rng.randrange(90)) for i in range(220)] + [("x", 100, 101), ("y", 101, 102), ("z", 102, 200)]
    methods = [(m, m % 3, m % 4 == 1, "C", f"m{m}()") for m in [*range(90), 100, 101, 102, 103]]
    g = graph_of(spark, calls, (), methods)
    seeds = [*range(90), 101, 103, 777]
    frame = spark.createDataFrame([(s,) for s in seeds] * 2, "method_id long")
    edges = g.calls.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    near = {s: {n: d for n, d in distances(calls, s).items() if d <= 3} for s in seeds}
    assert sorted(tuple(r) for r in traverse.reach(frame, edges, 3).collect()) == sorted((s, n, d) for s in seeds for n, d in near[s].items())
    known = {m[0]: m for m in methods}
    want = []
    for s in seeds:
        others = [n for n in near[s] if n != s and n in known]
        if others:
            want.append((s, len(others), sum(known[n][2] for n in others)))
    assert sorted(tuple(r) for r in traverse.impact(g, frame, 3, upstream=False).collect()) == sorted(want)
    up = [(c[0], c[2], c[1]) for c in calls]
    want = []
    for s in seeds:
        found = sorted((n, d) for n, d in distances(up, s).items() if 0 < d <= 6 and n in known and s in known and known[n][2] and known[n][1] == known[s][1])
        want += [(s, n, d) for n, d in found[:5]]
    assert sorted(tuple(r) for r in traverse.upstream_entries(g, frame, 6, 5).collect()) == sorted(want)
    none = traverse.impact(g, frame.where("false"), 3)
    assert none.count() == 0 == traverse.upstream_entries(g, frame.where("false")).count()


@pytest.mark.parametrize("most", [1, 2, 3, 4, 6])
def test_methods_on_short_cycles(spark, most):
    rng = random.Random(most)
    for n, m in ((12, 18), (30, 45), (9, 40)):
        calls = [(f"c{i}", rng.randrange(n), rng.randrange(n)) for i in range(m)] + [(f"h{i}", n + 1, i) for i in range(n)]
        g = graph_of(spark, calls)
        want = set()
        for s in range(n + 2):
            back = [distances(calls, c[2]).get(s, 99) + 1 for c in calls if c[1] == s]
            if min(back, default=99) <= most:
                want.add(s)
        assert {r[0] for r in traverse.on_cycle(g.calls, most).collect()} == want


def trails_by_hand(calls, least, most):
    out = []

    def grow(start, at, used, nodes):
        if len(used) >= least and at == start:
            out.append((start, ">".join(map(str, nodes)), len(used)))
        if len(used) < most:
            for c in calls:
                if c[1] == at and c[0] not in used:
                    grow(start, c[2], [*used, c[0]], [*nodes, c[2]])

    for c in calls:
        grow(c[1], c[2], [c[0]], [c[1], c[2]])
    return sorted(out)


def test_closed_trails_equal_walks_call_by_call(spark):
    """Loops, methods that call each other more than once, walks that come by their start again; and their numbers."""
    rng = random.Random(5)
    for n, m in ((3, 9), (5, 14), (2, 6)):
        calls = [(f"c{i}", rng.randrange(n), rng.randrange(n)) for i in range(m)]
        g, want = graph_of(spark, calls), trails_by_hand(calls, 2, 5)
        got = traverse.closed_trails(g.calls, 2, 5)
        assert sorted((r["start"], r["cycle"], r["depth"]) for r in got.collect()) == want
        counts = {r["depth"]: r["trails"] for r in traverse.trail_counts(g.calls, 2, 5).collect()}
        assert counts == {d: sum(w[2] == d for w in want) for d in range(2, 6)}
    assert {r["trails"] for r in traverse.trail_counts(g.calls.where("false"), 2, 3).collect()} == {0}
    first = rules.circular_dep(g, first=4).collect()
    assert sorted((r["method_id"], r["depth"], r["cycle"]) for r in first) == sorted((s, d, c) for s, c, d in want)[:4]


@pytest.mark.parametrize("strays", [0, 3, 40])
def test_impact_of_many_calls_is_counted_by_hubs(spark, monkeypatch, strays):
    """Every seed's bits over all calls took too long where nearly all methods are reached; now few hubs show what is reached."""
    rng = random.Random(strays)
    n = 150
    calls = [(f"c{i}", rng.randrange(n), rng.randrange(n)) for i in range(n * 12)]
    calls += [(f"s{i}", n + i, n + i + 1) for i in range(strays)] + [("in", n, 5), ("out", 7, 400), ("to", 7, 401), ("loose", 500, 501)]
    methods = [(m, 0, m % 4 == 1, "C", f"m{m}()") for m in [*range(n + strays + 1), 401, 500, 501, 600]]
    g = graph_of(spark, calls, (), methods)
    seeds = [*range(n + strays + 1), 400, 500, 600, 777]
    counted, plain = [], traverse._impact_of
    monkeypatch.setattr(traverse, "_impact_of", lambda known, left, *more: counted.append(left.count()) or plain(known, left, *more))
    frame = spark.createDataFrame([(s,) for s in seeds] * 2, "method_id long")
    known = {m[0]: m[2] for m in methods}
    for upstream in (False, True):
        near = {s: [m for m, d in distances([(c[0], c[2], c[1]) for c in calls] if upstream else calls, s).items() if 0 < d <= 4 and m in known] for s in seeds}
        want = sorted((s, len(f), sum(known[m] for m in f)) for s, f in near.items() if f)
        assert sorted(tuple(r) for r in traverse.impact(g, frame, 4, upstream).collect()) == want
    assert max(counted) <= len(seeds) - n * 3 // 4 if strays < 20 else True


def test_trails_are_counted_without_walks_of_five(spark, monkeypatch):
    """Walks of five calls, with all methods on the way, were too many; loops, pairs and repeated calls still count rightly."""
    made, walks = [], traverse.closed_walks
    monkeypatch.setattr(traverse, "closed_walks", lambda calls, length, *more, **named: made.append(length) or walks(calls, length, *more, **named))
    rng = random.Random(11)
    calls = [(f"c{i}", rng.randrange(5), rng.randrange(5)) for i in range(13)] + [("l1", 2, 2), ("l2", 2, 2), ("p", 1, 3), ("q", 3, 1), ("q2", 3, 1)]
    want = trails_by_hand(calls, 1, 5)
    got = {r["depth"]: r["trails"] for r in traverse.trail_counts(graph_of(spark, calls).calls, 1, 5).collect()}
    assert got == {d: sum(w[2] == d for w in want) for d in range(1, 6)} and max(made) <= 3


def test_blocks_of_seeds_reach_what_walks_reach(spark, monkeypatch):
    """Bits of all hubs by all methods were written and shuffled level by level; a task now follows a block of them by itself."""
    monkeypatch.setattr(blockreach, "STATE_BYTES", 8)
    rng, n = random.Random(3), 150
    calls = [(f"c{i}", rng.randrange(n), rng.randrange(n)) for i in range(n * 6)] + [(f"h{i}", i, 7) for i in range(n)] + [("s", 7, 900), ("t", 900, 901), ("w", 901, 902)]
    known = [(m, m % 4 == 1) for m in [*range(n), 900, 901, 5, 5]] + [(902, None), (903, True)]
    hops = spark.createDataFrame([c[1:] for c in calls] + [(None, 3), (4, None)], "a long, b long").distinct()
    dense = blockreach.numbered(hops, spark.createDataFrame(known, "node long, is_entry boolean"))
    assert dense.width == 64
    number = {r["id"]: r["node"] for r in dense.nodes.collect()}
    name = {v: k for k, v in number.items()}
    every = dense.of(spark.createDataFrame([(m,) for m in [*number, 1234, None]], "method_id long"))
    assert sorted(name[r["node"]] for r in every.collect()) == sorted({c[1] for c in calls})
    near = {s: {m for m, d in distances(calls, s).items() if d <= 3} for s in number}
    got = {name[r["node"]]: (r["n_methods"], r["n_entries"]) for r in blockreach.counts(dense, every, 3).collect()}
    assert got == {s: (sum(k[0] in near[s] for k in known), sum(k[0] in near[s] and bool(k[1]) for k in known)) for s in {c[1] for c in calls}}
    met = blockreach.hubs(dense, every, 3).collect()
    good, strays = {name[r["node"]] for r in met if r["good"]}, {name[r["node"]] for r in met if not r["good"]}
    ever = {c[2] for c in calls} & {k[0] for k in known}
    assert good and strays < ever and all(ever - near[h] <= strays for h in good)
    targets = spark.createDataFrame([(number[t],) for t in [*range(0, n, 2), 901, 902]], "node int")
    less = {}
    for r in blockreach.lacking(dense, targets, 3).collect():
        old = less.get(name[r["node"]], (0, 0))
        less[name[r["node"]]] = (old[0] + r["methods"], old[1] + r["entries"])
    missed = {s: [k for k in known if k[0] in {*range(0, n, 2), 901, 902} - near[s]] for s in number}
    assert {s: m for s, m in less.items() if any(m)} == {s: (len(m), sum(bool(k[1]) for k in m)) for s, m in missed.items() if m}


@pytest.mark.parametrize(("held", "at_once", "kept"), [(2_000_000, 1 << 18, 48_000_000), (40, 7, 0)])
def test_closed_walks_are_counted_without_shuffles(spark, monkeypatch, held, at_once, kept):
    """Walks of three calls were shuffled, thousands a method; now each task looks up those of its own methods, a few at a time."""
    monkeypatch.setattr(returns, "HELD_WALKS", held)
    monkeypatch.setattr(returns, "AT_ONCE", at_once)
    monkeypatch.setattr(edgefiles, "HELD_EDGES", kept)
    rng, n = random.Random(held), 14
    hops = {(rng.randrange(n), rng.randrange(n)): rng.randrange(1, 4) for _ in range(60)} | {(0, i): 1 for i in range(n)} | {(i, 0): 2 for i in range(n)}
    frame = spark.createDataFrame([(a, b, m) for (a, b), m in hops.items()], "a long, b long, many long")
    found = returns.first_returns(frame, n, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    want = {}
    for start in range(n):
        walks = {start: 1}
        for length in range(1, 6):
            far = {}
            for at, ways in walks.items():
                for (a, b), many in hops.items():
                    if a == at and b >= start:
                        far[b] = far.get(b, 0) + ways * many
            if start in far:
                want[start, length] = far.pop(start)
            walks = far
    assert {(r["a"], r["length"]): r["walks"] for r in found.collect()} == want
    assert [p for p in edgefiles.pieces(edgefiles.stored(frame.where("false"), "a", "b", "many"))] == []


def test_accesses_are_joined_once_for_all_depths(spark):
    """A join for each depth read all accesses as often as a trace is deep."""
    g = graph_of(spark, CALLS, ACCESSES)
    paths = traverse.trace(g, g.methods.where("is_entry").select("method_id"), 6)[1]
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert sorted((">".join(r["path"]), r["end"]) for r in paths.collect()) == by_hand(CALLS, ACCESSES, 1, 6)[1]
