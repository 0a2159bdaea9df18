"""Scans as streams of events: the state of every trace, kept by key, and chains of events joined as they come.

Events are rows of trace, event_id, ts, stage, files_done, files, as in operators.scans, whose batch reports are what
these streams come to on a finished table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators import scans
from sparkloom.scratch import fresh_path, saved
from sparkloom.streaming.capture import run_once

EVENT = "struct<ts:timestamp,event_id:long,stage:string,files_done:int,files:int>"
TRACE = f"struct<trace:string,stage:string,files_done:int,files:int,n_events:long,started:timestamp,updated:timestamp,late:long,timings:map<string,long>,pending:array<{EVENT}>,deadline:long>"
STATE = f"traces array<{TRACE}>"
OUT = "trace string, stage string, files_done int, files int, n_events long, started timestamp, updated timestamp, finished timestamp, timed_out boolean, late long, timings map<string,long>"
MILLISECOND = dt.timedelta(milliseconds=1)
EMPTY = (None, None, None, 0, None, None, 0, {}, [])
#: Groups that traces are dealt to: a call of the state's function costs much more than a trace.
GROUPS = 1024
#: Rows of a file of `in_files`, about.
FILE_ROWS = 500_000


def folded(state: tuple, events: list[tuple]) -> tuple:
    """The state after these events (ts, event_id, stage, files_done, files) in order; nothing follows a terminal one."""
    stage, done, files, n, started, updated, late, timings, pending = state
    timings = dict(timings)
    for ts, _, now, d, f in events:
        if stage in scans.TERMINAL:
            break
        if stage is not None and stage != now:
            timings[stage] = int((ts - updated) // MILLISECOND)
        elif stage is not None:
            timings.pop(stage, None)  # a stage is timed from its last event
        timings.pop(now, None)
        done, files = (b if a is None else a if b is None else max(a, b) for a, b in ((done, d), (files, f)))
        stage, n, started, updated = now, n + 1, ts if started is None else started, ts
    return stage, done, files, n, started, updated, late, timings, pending


def _kept(timeout_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {t[0]: (tuple(t[1:10]), t[10]) for t in state.get[0]} if state.exists else {}
        mark_ms, arrived, rows = state.getCurrentWatermarkMs(), {}, []
        mark = pd.Timestamp(mark_ms, unit="ms").to_pydatetime()
        for frame in () if state.hasTimedOut else frames:
            whole = lambda c: [None if pd.isna(x) else int(x) for x in c]
            for trace, *event in zip(frame["trace"], (t.to_pydatetime() for t in frame["ts"]), map(int, frame["event_id"]), frame["stage"], whole(frame["files_done"]), whole(frame["files"]), strict=True):
                arrived.setdefault(trace, []).append(tuple(event))
        for trace, events in arrived.items():
            now = held[trace][0] if trace in held else EMPTY
            pending, late = [tuple(e) for e in now[8]], now[6]
            for e in events:
                if now[5] is not None and e[0] < now[5]:
                    late += 1  # what it would change has been settled
                else:
                    pending.append(e)
            pending.sort(key=lambda e: e[:2])
            settled = [e for e in pending if e[0] < mark]
            pending = pending[len(settled) :]
            base = folded(now, settled)
            base = (*base[:6], late, base[7], pending)
            seen, deadline = folded(base, pending), None
            if timeout_ms is not None and seen[0] not in scans.TERMINAL:
                deadline = max(int(pd.Timestamp(seen[5]).timestamp() * 1000) + timeout_ms, mark_ms + 1)
            held[trace] = base, deadline
            rows.append((trace, seen, False))
        for trace in [t for t, (_, deadline) in held.items() if deadline is not None and deadline < mark_ms]:
            now = held.pop(trace)[0]
            rows.append((trace, folded(now, sorted(tuple(e) for e in now[8])), True))
        if held:
            state.update(([(t, *now, deadline) for t, (now, deadline) in held.items()],))
            deadlines = [deadline for _, deadline in held.values() if deadline is not None]
            if deadlines:
                state.setTimeoutTimestamp(max(min(deadlines), mark_ms + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield _rows(rows)

    return run


def _rows(found: list[tuple[str, tuple, bool]]) -> pd.DataFrame:
    """OUT of traces, their states, and whether they have timed out."""
    out = []
    for trace, (stage, done, files, n, started, updated, late, timings, _), timed_out in found:
        ended = stage in scans.TERMINAL
        out.append((trace, "FAILED" if timed_out and not ended else stage, done, files, n, started, updated, updated if ended else None, timed_out and not ended, late, timings))
    frame = pd.DataFrame(out, columns=["trace", "stage", "files_done", "files", "n_events", "started", "updated", "finished", "timed_out", "late", "timings"])
    for c in ("started", "updated", "finished"):
        frame[c] = pd.to_datetime(frame[c])
    for c in ("files_done", "files"):
        frame[c] = frame[c].astype("Int32")
    return frame


def states(events: DataFrame, delay: str = "1 hour", timeout_ms: int | None = None) -> DataFrame:
    """OUT of a stream of events, in update mode: a row for every trace that a batch brings something new of, and no others.

    Events are settled in order of ts, event_id once the watermark (`delay` behind the newest) has passed them; those after it
    wait in the state and count for the row that is put out. An event older than what is settled counts as late and changes
    nothing else. With `timeout_ms`, a trace that has not ended so long after its last event is put out as FAILED, timed_out,
    when the watermark passes that, and its state goes. The states of a GROUPS-th of the traces are kept and called together.
    """
    rows = events.select("trace", "event_id", "ts", "stage", "files_done", "files").withWatermark("ts", delay)
    wait = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.withColumn("dealt", F.pmod(F.xxhash64("trace"), F.lit(GROUPS)).cast("int")).groupBy("dealt").applyInPandasWithState(_kept(timeout_ms), OUT, STATE, "update", wait)


def in_files(rows: DataFrame, parts: int, order: str = "ts", file_rows: int = FILE_ROWS) -> DataFrame:
    """`rows` as a stream of `parts` batches in order of time: what a topic of a broker would bring.

    A batch is a file, or as many as every part has shares of about `file_rows` rows; the rows are made once.
    """
    spark, root = rows.sparkSession, fresh_path(rows.sparkSession)
    held = saved(rows)
    shares = 1 + held.count() // (parts * file_rows)
    cuts = held.select(F.percentile_approx(F.unix_micros(order), [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
    part = F.size(F.filter(F.lit(cuts[: parts - 1]).cast("array<long>"), lambda c: c < F.unix_micros(order)))
    dealt = held.withColumns({"_part": part, "_share": F.pmod(F.xxhash64(*(c for c, kind in held.dtypes if not kind.startswith("map"))), F.lit(shares)).cast("int")})
    if shares > 1 and dealt.groupBy("_part").agg(F.countDistinct("_share").alias("n")).where(F.col("n") < shares).count():
        shares, dealt = 1, dealt.withColumn("_share", F.lit(0))  # a part of few unlike rows: batches would take files of two parts
    for i in range(parts):
        own = dealt.where(F.col("_part") == i).drop("_part")
        if shares > 1:
            own.repartition(shares, "_share").write.partitionBy("_share").mode("append").parquet(root)
        else:
            own.drop("_share").coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", shares).parquet(root).select(rows.columns)


def kept(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key that a stream in update mode has put out, and `batch`, the batch it is from."""
    out = fresh_path(stream.sparkSession)
    run_once(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), "update")
    rows = stream.sparkSession.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", batch long").parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")


def chains(events: DataFrame, within: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """trace, requested, fetched, analyzed, ended (event ids), requested_at, outcome: chains of a stream of events.

    Each fetch follows a request of its trace, each analysis that fetch, and a terminal event that analysis, each within the
    given time; a chain without a terminal event in that time comes out FAILED, with no `ended`, once the watermark says
    that none will come. Where several events would do, each makes a chain of its own.
    """
    of = lambda stages, name: events.where(F.col("stage").isin(stages)).select(F.col("trace").alias(f"{name}_trace"), F.col("event_id").alias(name), F.col("ts").alias(f"{name}_at"), *([F.col("stage").alias("outcome")] if name == "ended" else [])).withWatermark(f"{name}_at", delay)
    after = lambda a, b: F.expr(f"{a}_trace = {b}_trace AND {b}_at > {a}_at AND {b}_at <= {a}_at + INTERVAL {within}")
    requested, fetched, analyzed, ended = of(["FETCHING"], "requested"), of(["ANALYZING"], "fetched"), of(["SQL_PARSING"], "analyzed"), of(scans.TERMINAL, "ended")
    # a join's result has one time that a watermark follows, that of its last event; the request's goes on as a plain column
    first = requested.join(fetched, after("requested", "fetched")).withColumn("asked", F.expr("requested_at + INTERVAL 0 SECOND")).drop("requested_at", "requested_trace")
    second = first.join(analyzed, after("fetched", "analyzed")).drop("fetched_at", "fetched_trace")
    rows = second.join(ended, after("analyzed", "ended"), "left")
    return rows.select(F.col("analyzed_trace").alias("trace"), "requested", "fetched", "analyzed", "ended", F.col("asked").alias("requested_at"), F.coalesce("outcome", F.lit("FAILED")).alias("outcome"))


def with_end(events: DataFrame) -> DataFrame:
    """`events` and one event of each stage, all of trace `end of events`, a year after the last: the watermarks of all stages of a stream then pass all others.

    A null trace would not do, as joins leave those rows out before any watermark sees them.
    """
    last = events.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts")).where("ts IS NOT NULL").select("ts", F.explode(F.array(*map(F.lit, scans.EVENTS))).alias("stage"))
    own = {"ts": F.col("ts"), "stage": F.col("stage"), "trace": F.lit("end of events")}
    return events.unionByName(last.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema)))


def drained(stream: DataFrame) -> DataFrame:
    """All rows that a stream in append mode has put out."""
    out = fresh_path(stream.sparkSession)
    run_once(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return stream.sparkSession.read.parquet(out).select(stream.columns)
