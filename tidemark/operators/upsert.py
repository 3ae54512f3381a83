"""The conditional upsert: a write takes effect only if it is newer than all that came before for its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.storage import written


def _with_earlier(df: DataFrame, ts: str, seq: str) -> DataFrame:
    """Adds the newest timestamp before each write of its key. A refused timestamp never exceeds the greatest accepted one, so
    refusals need no account.

    Rows are dealt out by ranges of key and seq, so a key of any size is cut across tasks; what earlier ranges hold of a key
    comes from a row for each key and range, and is joined to those keys only that lie in more than one.
    """
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", seq)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    tops = ranged.groupBy("key", "_range").agg(F.max(ts).alias("_top"))
    before = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = tops.withColumn("_base", F.max("_top").over(before)).filter(F.col("_base").isNotNull()).select("key", "_range", "_base")
    own = Window.partitionBy("_range", "key").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    # a range is one task's: at most two keys of it, its first and its last, lie in others as well
    out = ranged.join(F.broadcast(cut), ["key", "_range"], "left").withColumn("_own", F.max(ts).over(own))
    return out.withColumn("_earlier", F.greatest("_own", "_base")).select(*df.columns, "_earlier")


def accepted(df: DataFrame, ts: str = "ts_ns", seq: str = "seq") -> DataFrame:
    """Writes that take effect when replayed in the order of seq."""
    return _with_earlier(df, ts, seq).filter(F.col("_earlier").isNull() | (F.col("_earlier") < F.col(ts))).drop("_earlier")


def late(df: DataFrame, ts: str = "ts_ns", seq: str = "seq") -> DataFrame:
    """Writes that are accepted without effect, for an equal or newer version was there."""
    return _with_earlier(df, ts, seq).filter(F.col("_earlier") >= F.col(ts)).drop("_earlier")


def effective(batch: DataFrame, existing: DataFrame, ts: str = "ts_ns") -> DataFrame:
    """Rows of batch (one a key) that are newer than what existing holds for the key."""
    there = existing.join(batch.select("key"), "key", "left_semi").groupBy("key").agg(F.max(ts).alias("_there"))
    return batch.join(there, "key", "left").filter(F.col("_there").isNull() | (F.col("_there") < F.col(ts))).drop("_there")
