"""Component statistics, pruning, samples, layouts, compaction figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import SAMPLE_EVERY, byte_length, index_record_length, value_record_length
from tidemark.plans.ordered import with_running


def key_ranges(df: DataFrame, by: str | Column, ts: str = "ts_ns", suffix: str = "ts_ns", keys: bool = True) -> DataFrame:
    """First and last key, oldest and newest timestamp of each group; the number of distinct keys if wanted."""
    aggs = [F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min(ts).alias(f"min_{suffix}"), F.max(ts).alias(f"max_{suffix}")]
    return df.groupBy(by).agg(*aggs, *([F.count_distinct("key").alias("key_count")] if keys else []))


def covers_key(key: str) -> Column:
    return (F.col("first_key") <= key) & (F.col("last_key") >= key)


def covers_timestamp(ts: int, suffix: str = "ts_ns") -> Column:
    return F.lit(ts).between(F.col(f"min_{suffix}"), F.col(f"max_{suffix}"))


def covers_newer(ts: int | None, suffix: str = "ts_ns") -> Column:
    """Groups that may hold ts or newer; all of them if ts is None."""
    return F.lit(True) if ts is None else F.col(f"max_{suffix}") >= ts


def roll_up(manifest: DataFrame) -> DataFrame:
    """Bounds of each generation from those of its components."""
    return manifest.groupBy("generation").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.min("min_ts_ns").alias("min_ts_ns"), F.max("max_ts_ns").alias("max_ts_ns"))


def sparse_samples(df: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """Every so-many-th key in order, with its offset in an index file."""
    keys = df.select("key").distinct()
    return with_running(keys, ["key"], index_record_length("key"), position="_n", before="idx_off").filter(F.col("_n") % every == 0).select("key", "idx_off")


def index_layout(df: DataFrame, payload: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Where each value lies in a value file that holds them in key order."""
    rows = df.select("key", *payload, byte_length(value).alias("len"))
    return with_running(rows, ["key"], F.col("len") + 16, before="start_off")


def log_layout(df: DataFrame, length: Column, seq: str = "seq") -> DataFrame:
    """Length and end of each record in a write log that holds them in the order of seq."""
    return with_running(df.select(seq, length.alias("rec_len")), [seq], F.col("rec_len"), upto="end_off")


def live_bytes(winners: DataFrame, value: str = "value") -> DataFrame:
    return winners.agg(F.coalesce(F.sum(byte_length(value)), F.lit(0)).alias("memsize"), F.count(F.lit(1)).alias("n"))


def compaction_delta(df: DataFrame) -> DataFrame:
    """For each generation: keys of its components, keys after compaction, and rows that it would reclaim."""
    per = df.groupBy("generation", "key").agg(F.count_distinct("component").alias("_c"))
    out = per.groupBy("generation").agg(F.sum("_c").alias("n_in"), F.count(F.lit(1)).alias("n_out"))
    return out.withColumn("reclaimed", F.col("n_in") - F.col("n_out"))


def value_file_bytes(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg(F.coalesce(F.sum(value_record_length(value)), F.lit(0)).alias("bytes"))
