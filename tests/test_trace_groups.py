import datetime as dt

from pyspark.sql import functions as F

from sparkloom.operators import scans
from sparkloom.streaming import traces

SCHEMA = "trace string, event_id long, ts timestamp, stage string, files_done int, files int"
T0 = dt.datetime(2024, 1, 1)


def events(spark, n, traces_=40):
    stages = ["FETCHING", "ANALYZING", "SQL_PARSING", "COMPLETED"]
    return spark.createDataFrame([(f"t{i % traces_}", i, T0 + dt.timedelta(minutes=i), stages[i * 4 // n], i % 7, 9) for i in range(n)], SCHEMA)


def test_parts_of_several_files_are_whole_batches_in_order_of_time(spark):
    rows, seen = events(spark, 400), []
    traces.run_once(traces.in_files(rows, 4, file_rows=25), lambda batch, number: seen.append(sorted(batch.select("event_id").toPandas()["event_id"])))
    assert [len(s) for s in seen] == [100] * 4 and sum(seen, []) == list(range(400))


def test_equal_rows_and_empty_parts_lose_nothing(spark):
    rows, seen = events(spark, 1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"), []
    traces.run_once(traces.in_files(rows, 4, file_rows=10), lambda batch, number: seen.append(batch.count()))
    assert sum(seen) == 300


def test_traces_share_a_call_of_the_state(spark, monkeypatch):
    """A call for each trace cost about 9 ms; now the traces of a group have one."""
    monkeypatch.setattr(traces, "GROUPS", 2)
    rows = events(spark, 200)
    found = traces.states(traces.in_files(rows, 2))
    got = {r["trace"]: (r["stage"], r["n_events"], r["updated"]) for r in traces.kept(found, ["trace"]).collect()}
    assert got == {r["trace"]: (r["stage"], r["n_events"], r["updated"]) for r in scans.states(rows).collect()} and len(got) == 40


def test_traces_of_a_group_time_out_each_at_its_own_time(spark, monkeypatch):
    monkeypatch.setattr(traces, "GROUPS", 1)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([("a", 1, at(0), "FETCHING", 0, 9), ("b", 2, at(200), "FETCHING", 0, 9), ("c", 3, at(300), "ANALYZING", 0, 9), ("c", 4, at(400), "ANALYZING", 0, 9)], SCHEMA)
    seen = []
    found = traces.states(traces.in_files(rows, 4), "1 minute", 150 * 60_000)
    traces.run_once(found, lambda batch, number: seen.extend((r["trace"], r["stage"], r["timed_out"]) for r in batch.collect()), "update")
    assert [s for s in seen if s[2]] == [("a", "FAILED", True), ("b", "FAILED", True)]
