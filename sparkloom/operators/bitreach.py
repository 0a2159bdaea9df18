"""Reach of very many seeds at once: 64 seeds are the bits of one number, so a row (block, node, bits) stands for up to 64 pairs.

Seeds are numbered without gaps, 64 to a block. A level joins the rows that are new with the edges and ORs what arrives at each
node; a bit that was there before is none. Counts by seed are sums over bits, made in tasks before anything is shuffled, and
seeds are unpacked only where a result has a row for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import saved

WIDTH = 64
#: Seeds that are numbered together, about.
NUMBERED_AT_ONCE = 4096


def numbered(seeds: DataFrame, width: int = WIDTH) -> DataFrame:
    """seed, block, bit of the distinct seeds (method_id), `width` to a block."""
    seeds = seeds.select(F.col("method_id").alias("seed")).distinct()
    parts = max(1, seeds.count() // NUMBERED_AT_ONCE)
    rows = seeds.withColumn("part", F.pmod(F.xxhash64("seed"), F.lit(parts)))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("seed")) - 1
    rows = rows.withColumn("nth", nth)
    return saved(rows.select("seed", (F.col("part") * (1 << 32) + F.floor(F.col("nth") / width)).cast("long").alias("block"), (F.col("nth") % width).cast("int").alias("bit")))


def bit(column: str = "bit") -> Column:
    """The number whose only bit is that one."""
    return F.expr(f"shiftleft(1L, {column})")


def levels(seeds: DataFrame, edges: DataFrame, most: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """depth, new, all: for each depth up to `most`, rows block, node, bits that are new there, and of all depths so far.

    seeds: seed, block, bit; edges: a, b, followed from a to b. Depth 0 has the seeds themselves. Ends before a depth that
    brings nothing.
    """
    hops = saved(edges.select("a", "b").distinct())
    state = saved(seeds.groupBy("block", F.col("seed").alias("node")).agg(F.bit_or(bit()).alias("seen")).withColumn("new", F.col("seen")))
    for depth in range(most + 1):
        yield depth, state.where("new <> 0").select("block", "node", F.col("new").alias("bits")), state.select("block", "node", F.col("seen").alias("bits"))
        if depth == most:
            return
        sent = state.where("new <> 0").join(hops, F.col("node") == F.col("a")).select("block", F.col("b").alias("node"), F.lit(0).cast("long").alias("seen"), F.col("new").alias("got"))
        both = state.select("block", "node", "seen", F.lit(0).cast("long").alias("got")).unionByName(sent)
        met = both.groupBy("block", "node").agg(F.bit_or("seen").alias("seen"), F.bit_or("got").alias("got"))
        state = saved(met.select("block", "node", F.expr("seen | got").alias("seen"), F.expr("got & ~seen").alias("new")))
        if state.where("new <> 0").isEmpty():
            return


def unpacked(rows: DataFrame) -> DataFrame:
    """`rows` (bits, ...) with `bit` in place of bits, a row for each bit that is set."""
    set_ = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return rows.withColumn("bit", F.explode(set_)).drop("bits")


def counts(rows: DataFrame, **flags: Column) -> DataFrame:
    """block, bit, and for each flag the rows (block, bits, ...) that have it and that bit."""
    sums = [F.sum(F.when(flag, F.expr(f"shiftright(bits, {i}) & 1")).otherwise(0)).alias(f"{name}_{i}") for i in range(WIDTH) for name, flag in flags.items()]
    by = rows.groupBy("block").agg(*sums)
    every = F.array(*(F.struct(F.lit(i).alias("bit"), *(F.col(f"{name}_{i}").alias(name) for name in flags)) for i in range(WIDTH)))
    return by.select("block", F.explode(every).alias("c")).select("block", "c.*")
