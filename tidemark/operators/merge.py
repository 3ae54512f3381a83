"""The last-write-wins merge and what is made of it: snapshots, listings, lookups, incremental reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lww(df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str | Column] = ("ts_ns", "seq")) -> DataFrame:
    """One row for each key: the one that is greatest by order, which should be total.

    An aggregate, so that map tasks send one row a key even where a key has a third of all rows, and so that filters on
    the keys reach the scan.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def lww_first(df: DataFrame, keys: Sequence[str] = ("key",), ts: str = "ts_ns", seq: str = "seq") -> DataFrame:
    """The newest version of each key; of equal timestamps, the one written first."""
    return lww(df, keys, (F.col(ts), -F.col(seq)))


def newest(df: DataFrame, keys: Sequence[str] = ("key",), ts: str = "ts_ns") -> DataFrame:
    """Keys and newest timestamps; a hash aggregate that reads no values."""
    return df.groupBy(*keys).agg(F.max(ts).alias(ts))


def newer_than(df: DataFrame, cutoff: int | None, ts: str = "ts_ns") -> DataFrame:
    """Rows strictly newer than cutoff (none: 0, so a timestamp of 0 is never listed).

    Put below the merge: a winner passes by itself and losers do not matter, so both orders give the same rows, and here
    the filter reaches the scan.
    """
    return df.filter(F.col(ts) > F.lit(cutoff or 0))


def list_keys(df: DataFrame, cutoff: int | None = None, ts: str = "ts_ns") -> DataFrame:
    return newest(newer_than(df, cutoff, ts), ts=ts)


def stream_all(df: DataFrame, cutoff: int | None = None, ts: str = "ts_ns", order: Sequence[str | Column] = ("ts_ns", "seq")) -> DataFrame:
    """Newest versions after cutoff; sort by key before reading them in order."""
    return lww(newer_than(df, cutoff, ts), order=order)


def as_of(df: DataFrame, ts_ns: int, ts: str = "ts_ns", order: Sequence[str | Column] = ("ts_ns", "seq")) -> DataFrame:
    """The state at a past time: later versions are dropped before the merge."""
    return lww(df.filter(F.col(ts) <= ts_ns), order=order)


def get(df: DataFrame, *keys: str, order: Sequence[str | Column] = ("ts_ns", "seq")) -> DataFrame:
    """The newest versions of some keys; keys that do not exist give no row."""
    return lww(df.filter(F.col("key").isin(*keys)), order=order)


def get_many(df: DataFrame, wanted: DataFrame, order: Sequence[str | Column] = ("ts_ns", "seq")) -> DataFrame:
    """As get(), for a table of keys of any size."""
    return lww(df.join(wanted.select("key"), "key", "left_semi"), order=order)


def not_found(wanted: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of wanted whose key df does not hold. df is cut down to the wanted keys first, so that its own keys are not sent around."""
    held = df.select("key").join(wanted.select("key"), "key", "left_semi").distinct()
    return wanted.join(held, "key", "left_anti")


def merge(sources: Sequence[DataFrame], keys: Sequence[str] = ("key",), ts: str = "ts_ns", tie: Sequence[str] = ()) -> DataFrame:
    """Merges sources into one row a key; of equal timestamps the last source wins, and within a source the greatest tie."""
    if not sources:
        raise ValueError("nothing to merge")
    marked = [s.withColumn("source_ordinal", F.lit(i)) for i, s in enumerate(sources)]
    return lww(reduce(DataFrame.unionByName, marked), keys, (ts, "source_ordinal", *tie))


def merge_replicas(df: DataFrame, replica: str, ts: str = "ts_ns") -> DataFrame:
    """Keys over all replicas, with the newest timestamp and the number of replicas that hold the key."""
    held = df.groupBy("key", replica).agg(F.max(ts).alias(ts))
    return held.groupBy("key").agg(F.max(ts).alias(ts), F.count(replica).alias("replicas"))
