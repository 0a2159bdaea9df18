"""Places of rows in an order, counted range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import saved


def in_order(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(`rows` with place and so_far, totals): the rows of a seed up to each one in the given order, and the crossing ones among them.

    rows: seed, crosses, ...; totals: seed, total of the crossing ones. Rows are sorted by ranges of seed and order, so that many rows of
    one seed lie in several tasks; each range counts its own, and sums over the ranges before come to that.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = saved(rows.repartitionByRange(parts, "seed", *order).withColumn("range", F.spark_partition_id()))
    sums = saved(held.groupBy("seed", "range").agg(F.count("*").alias("n"), F.count_if("crosses").alias("c")))  # a row a seed, and one a range more
    before = Window.partitionBy("seed").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("seed", "range", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"earlier_{x}") for x in ("n", "c")))
    own = Window.partitionBy("seed", "range").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = held.withColumns({"place": F.row_number().over(own), "so_far": F.sum(F.col("crosses").cast("long")).over(upto)}).join(earlier, ["seed", "range"])
    counted = out.withColumns({"place": F.col("place") + F.col("earlier_n"), "so_far": F.col("so_far") + F.col("earlier_c")})
    return counted.drop("range", "earlier_n", "earlier_c"), sums.groupBy("seed").agg(F.sum("c").alias("total"))
