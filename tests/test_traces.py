import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import scans
from sparkloom.streaming import traces

SCHEMA = "trace string, event_id long, ts timestamp, stage string, files_done int, files int"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def some_events(n, seed):
    rng = random.Random(seed)
    stages = ["FETCHING", "ANALYZING", "SQL_PARSING", "WRITING_GRAPH", "COMPLETED", "FAILED"]
    return [(f"t{rng.randrange(9)}", i, at(rng.randrange(3000)), rng.choices(stages, [5, 5, 5, 5, 1, 1])[0], rng.choice([None, rng.randrange(80)]), 80) for i in range(n)]


def staged(spark, batches):
    """A stream whose batches are these lists of events."""
    root = "file://" + tempfile.mkdtemp(prefix="spark-events-")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)


def test_the_stream_comes_to_what_the_batch_reports(spark):
    events = spark.createDataFrame(some_events(150, 1), SCHEMA)
    got = {r["trace"]: r for r in traces.kept(traces.states(traces.in_files(events, 5)), ["trace"]).collect()}
    want = {r["trace"]: r for r in scans.states(events).collect()}
    assert got.keys() == want.keys()
    for trace, r in want.items():
        g = got[trace]
        assert all(g[c] == r[c] for c in ("stage", "files_done", "files", "n_events", "started", "updated", "finished")), (g, r)
        assert g["timings"] == {t["stage"]: t["millis"] for t in r["timings"]} and g["late"] == 0


def test_a_batch_puts_out_changed_traces_alone(spark):
    stream = staged(spark, [[("a", 1, at(0), "FETCHING", 0, 9), ("b", 2, at(1), "FETCHING", 0, 9)], [("a", 3, at(300), "ANALYZING", 3, 9)], [("c", 4, at(600), "FAILED", None, None)]])
    seen = []
    traces.run_once(traces.states(stream), lambda batch, number: seen.append(sorted((r["trace"], r["stage"]) for r in batch.collect())), "update")
    assert [s for s in seen if s] == [[("a", "FETCHING"), ("b", "FETCHING")], [("a", "ANALYZING")], [("c", "FAILED")]]


def test_late_events_and_events_out_of_order(spark):
    """Within the delay order does not matter; what is older than the settled events counts as late; nothing follows an end."""
    stream = staged(spark, [[("a", 1, at(50), "ANALYZING", 1, 9)], [("a", 2, at(20), "FETCHING", 0, 9), ("z", 9, at(500), "FETCHING", 0, 1)], [("a", 3, at(55), "COMPLETED", 9, 9), ("z", 10, at(501), "ANALYZING", 0, 1)], [("a", 4, at(10), "FETCHING", 0, 9), ("a", 5, at(700), "FAILED", 9, 9)]])
    got = {r["trace"]: r for r in traces.kept(traces.states(stream, "1 hour"), ["trace"]).collect()}
    a = got["a"]
    assert (a["stage"], a["n_events"], a["started"], a["finished"]) == ("COMPLETED", 3, at(20), at(55)) and a["timings"] == {"FETCHING": 1_800_000, "ANALYZING": 300_000}
    assert a["late"] <= 1 and got["z"]["stage"] == "ANALYZING"


def test_traces_without_an_end_time_out(spark):
    stream = staged(spark, [[("a", 1, at(0), "FETCHING", 0, 9), ("b", 2, at(5), "COMPLETED", 9, 9)], [("c", 3, at(1000), "FETCHING", 0, 9)], [("c", 4, at(1001), "ANALYZING", 0, 9)]])
    got = {r["trace"]: (r["stage"], r["timed_out"], r["finished"]) for r in traces.kept(traces.states(stream, "10 minutes", 3_600_000), ["trace"]).collect()}
    assert got["a"] == ("FAILED", True, None) and got["b"] == ("COMPLETED", False, at(5)) and got["c"] == ("ANALYZING", False, None)


@pytest.mark.parametrize("parts", [1, 4])
def test_chains(spark, parts):
    events = some_events(160, 7)
    frame = traces.with_end(spark.createDataFrame(events, SCHEMA))
    got = traces.drained(traces.chains(traces.in_files(frame, parts), "4 hours"))
    by, want = {}, []
    for e in events:
        by.setdefault((e[0], e[3]), []).append(e)
    near = lambda e, stages: [x for s in stages for x in by.get((e[0], s), []) if e[2] < x[2] <= e[2] + dt.timedelta(hours=4)]
    for r in events:
        if r[3] == "FETCHING":
            for f in near(r, ["ANALYZING"]):
                for a in near(f, ["SQL_PARSING"]):
                    ends = near(a, scans.TERMINAL)
                    want += [(r[0], r[1], f[1], a[1], e[1], e[3]) for e in ends] or [(r[0], r[1], f[1], a[1], None, "FAILED")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.select("trace", "requested", "fetched", "analyzed", "ended", "outcome").collect()), key=key) == sorted(want, key=key) and want


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert traces.with_end(none).count() == 0
    assert scans.states(none).select(F.count("*")).first()[0] == 0
