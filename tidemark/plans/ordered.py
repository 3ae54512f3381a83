"""Positions and running totals in a global order, without moving all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.storage import written


def with_running(df: DataFrame, order: Sequence[str], value: Column, position: str | None = None, before: str | None = None, upto: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds a row's position (from 1) and the totals of value before it and up to it, in the order given.

    Rows are dealt out by ranges and written once; each range is summed by itself and lifted by the totals of the ranges
    before it. What is broadcast is one row for each range. The order must be total for results that repeat.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.withColumn("_v", value.cast("long")).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_v"), F.lit(0)).alias("_s"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    own = Window.partitionBy("_range").orderBy(*order)
    out = ranged.join(F.broadcast(base), "_range").withColumn("_row", F.row_number().over(own)).withColumn("_upto", F.col("_s0") + F.coalesce(F.sum("_v").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    if position:
        out = out.withColumn(position, F.col("_n0") + F.col("_row"))
    if before:
        out = out.withColumn(before, F.col("_upto") - F.coalesce("_v", F.lit(0)))
    if upto:
        out = out.withColumn(upto, F.col("_upto"))
    return out.drop("_v", "_range", "_n0", "_s0", "_row", "_upto")
