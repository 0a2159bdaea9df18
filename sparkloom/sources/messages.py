"""Keyed messages by topic, as a sink for batches and streams that takes each run or batch once.

A task writes its messages to one staged file a topic and says so in its commit message; the driver puts all files of a
run in place by renames and then notes the run. A run (or batch of a stream) that is noted already leaves nothing, so a
repeated write adds no message; one that broke off before its note is put in place anew under the same names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from sparkloom.scratch import fresh_path

#: Bytes of a topic's messages that a task holds before it writes them on.
HELD_BYTES = 1 << 20


@dataclass
class Staged(WriterCommitMessage):
    """topic and staged file of each topic that a task has messages of."""

    files: list[tuple[str, str]]


class Topics:
    """The files of a folder of topics, staged by tasks and put in place by the driver."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        """topic, key, value rows as lines of JSON."""
        store, root = fs.FileSystem.from_uri(self.root)
        out: dict[str, tuple[str, pa.NativeFile]] = {}
        for batch in batches:
            for topic, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if topic not in out:
                    store.create_dir(f"{root}/_staged", recursive=True)
                    name = f"_staged/{uuid.uuid4().hex}"
                    out[topic] = name, store.open_output_stream(f"{root}/{name}", buffer_size=HELD_BYTES)
                out[topic][1].write((json.dumps({"key": key, "value": value}, ensure_ascii=False) + "\n").encode())
        for _, stream in out.values():
            stream.close()
        return Staged([(topic, name) for topic, (name, _) in out.items()])

    def place(self, messages: list[Staged | None], run: str) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        note = f"{root}/_runs/{run}"
        files = sorted((topic, name) for m in messages if m for topic, name in m.files)
        if store.get_file_info(note).type == fs.FileType.File:
            self.drop(messages)
            return
        for topic in {t for t, _ in files}:  # what a broken-off try has left of this run
            store.create_dir(f"{root}/topic={topic}", recursive=True)
            for old in store.get_file_info(fs.FileSelector(f"{root}/topic={topic}")):
                if old.base_name.startswith(f"{run}-"):
                    store.delete_file(old.path)
        for i, (topic, name) in enumerate(files):
            store.move(f"{root}/{name}", f"{root}/topic={topic}/{run}-{i:05d}.json")
        store.create_dir(f"{root}/_runs", recursive=True)
        with store.open_output_stream(note) as out:
            out.write(json.dumps([t for t, _ in files]).encode())

    def drop(self, messages: list[Staged | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        for m in messages:
            for _, name in m.files if m else []:
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{name}")


class BatchWriter(Topics, DataSourceArrowWriter):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(batches)

    def commit(self, messages: list[Staged | None]) -> None:
        self.place(messages, self.run)

    def abort(self, messages: list[Staged | None]) -> None:
        self.drop(messages)


class StreamWriter(Topics, DataSourceStreamArrowWriter):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(batches)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.place(messages, f"{self.run}-{batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class MessageSink(DataSource):
    """Options: path, and run, the name of what is written (of a stream, of all its batches)."""

    @classmethod
    def name(cls) -> str:
        return "sparkloom_messages"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], self.options["run"])

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"], self.options["run"])


def publish(messages: DataFrame, root: str, run: str) -> None:
    """Write messages (topic, key, value) below `root`, a stream to its end; a run, or batch of a stream, that is there already adds nothing.

    Rows of a null topic are none. A run's name goes into file names.
    """
    spark = messages.sparkSession
    spark.dataSource.register(MessageSink)
    rows = messages.where("topic IS NOT NULL").select("topic", F.col("key").cast("string"), F.col("value").cast("string"))
    options = {"path": root, "run": run}
    if messages.isStreaming:
        query = rows.writeStream.format("sparkloom_messages").options(**options).option("checkpointLocation", fresh_path(spark)).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    else:
        rows.write.format("sparkloom_messages").options(**options).mode("append").save()


def published(spark: SparkSession, root: str, *topics: str) -> DataFrame:
    """topic, key, value of all messages below `root`, or of those topics."""
    rows = spark.read.schema("key string, value string, topic string").option("basePath", root).json(root)
    rows = rows.where(F.col("topic").isin(*topics)) if topics else rows
    return rows.select("topic", "key", "value")
