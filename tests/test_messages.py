import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import report, scans
from sparkloom.sources import messages

ROWS = [("a", "k1", "v1"), ("a", "k2", 'say "hi"\n é'), ("b", None, "v3"), (None, "k4", "v4"), ("b", "k5", None)]
SCHEMA = "topic string, key string, value string"


@pytest.fixture
def root():
    return "file://" + tempfile.mkdtemp(prefix="spark-topics-")


def back(spark, root, *topics):
    return sorted((tuple(r) for r in messages.published(spark, root, *topics).collect()), key=str)


def test_batches_are_published_once(spark, root):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    want = sorted((r for r in ROWS if r[0]), key=str)
    for _ in range(2):
        messages.publish(frame, root, "one")
        assert back(spark, root) == want
    messages.publish(frame.limit(0), root, "none")
    messages.publish(frame, root, "two")
    assert back(spark, root) == sorted(want * 2, key=str) and back(spark, root, "b") == sorted([r for r in want if r[0] == "b"] * 2, key=str)
    assert not os.listdir(root[7:] + "/_staged")


def test_a_run_that_broke_off_is_put_in_place_anew(spark, root):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    messages.publish(frame, root, "one")
    os.remove(root[7:] + "/_runs/one")  # as if the driver had been lost before its note
    messages.publish(frame, root, "one")
    assert back(spark, root) == sorted((r for r in ROWS if r[0]), key=str)


def test_streams_are_published_batch_by_batch(spark, root):
    source = "file://" + tempfile.mkdtemp(prefix="spark-in-")
    for part in (ROWS[:2], ROWS[2:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second time without its checkpoint: the same batches come again
        messages.publish(stream(), root, "s")
        assert back(spark, root) == sorted((r for r in ROWS if r[0]), key=str)


def test_events_go_to_topics_of_their_class(spark):
    rows = [("t", 1, "FETCHING", 3), ("t", 2, "FAILED", None), ("u", 3, "UNKNOWN", 1)]
    events = spark.createDataFrame(rows, "trace string, event_id long, stage string, files_done int").withColumn("event", scans.event_of(F.col("stage")))
    got = sorted(tuple(r) for r in report.event_messages(events).collect())
    assert got == [("lineage.ProcessFailed", "t", '{"trace":"t","event_id":2,"stage":"FAILED"}'), ("lineage.ScanRequested", "t", '{"trace":"t","event_id":1,"stage":"FETCHING","files_done":3}')]


def test_prompts_by_name(spark):
    rows = spark.createDataFrame([("t", ["a", "b"], None)], "table string, columns array<string>, findings string")
    got = report.named_prompts("dead_column_analysis", rows).first()
    assert got["name"] == "dead_column_analysis" and "of t that" in got["prompt"] and "Columns: a, b\n" in got["prompt"] and "so far: \n" in got["prompt"]
    with pytest.raises(KeyError, match="endpoints, methods"):
        report.named_prompts("field_impact_analysis", rows)
