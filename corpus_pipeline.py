"""The corpus pipeline: toxicity, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; texts that a stage rewrites get a new n_chars. Other columns of documents are left out, whatever their names.
Empty tables go through all stages. A null or empty text is kept by every stage but may be a copy of none. Rows of one
doc_id are judged together where a stage drops documents (copies, leaks) and each on its own text for toxicity and lines;
rows of a null doc_id are one such group. Of equal or near-equal texts the one of the least doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chosenpath, lines, packing, tiling, toxicity
from sparkloom.llm.queries import vocabulary
from sparkloom.scratch import saved
from sparkloom.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = ["lang", "source", "n_chars"]
#: Document ids that are broadcast to leave their rows out (a few dozen bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose doc_id (null too) is not among those of `gone`."""
    ids = saved(gone.select(F.col("doc_id").alias("gone_id")).distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(COLUMNS).join(few, docs["doc_id"].eqNullSafe(ids["gone_id"]), "left_anti")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it is fitted on this stage's own input."""
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=["text", *OTHERS]).where("predicted = 0").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later document repeats; those without such lines stay as they are."""
    done = lines.dedup_lines(docs, keep=["text", *OTHERS])
    changed = F.col("n_dropped") > 0
    return done.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    classes = chosenpath.similarity_classes(docs)
    return without(docs, classes.where("NOT (doc_id <=> class_id)"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whole or reordered."""
    found = tiling.leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("toxicity", keep_clean),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", one_of_each_class),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: A fitted classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
