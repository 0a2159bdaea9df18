"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node of each node's component, for all nodes of the edges u, v.

    Each round links every node's larger neighbours, then its smaller ones, to the least node around it; the number of
    rounds grows with the logarithm of the longest chain. Rounds are written to the shared folder.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _state(now)
        if new == state:
            break
        state = new
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
