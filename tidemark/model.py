"""Record and manifest shapes, table options, error catalogue."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One version of one key. ts_ns is the order: TIMESTAMP holds microseconds only and would make false ties.
RECORD = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("value", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
#: A row of an immutable component; ordinal is the publication order of components.
STORED = T.StructType(
    [*RECORD.fields, T.StructField("checksum", T.BinaryType()), T.StructField("generation", T.IntegerType()), T.StructField("component", T.StringType()), T.StructField("ordinal", T.LongType())]
)
MANIFEST = T.StructType(
    [
        T.StructField("component", T.StringType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("first_key", T.StringType()),
        T.StructField("last_key", T.StringType()),
        T.StructField("min_ts_ns", T.LongType()),
        T.StructField("max_ts_ns", T.LongType()),
        T.StructField("key_count", T.LongType()),
        T.StructField("value_bytes", T.LongType()),
        T.StructField("created_ns", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)
#: Longest key in bytes, memtable limit, components that trigger a compaction.
MAX_KEY_BYTES = 255
MEMTABLE_BYTES = 8 * 1024 * 1024
COMPACT_AT = 5
#: Seconds without a write after which a tick flushes; seconds between ticks.
IDLE_SECONDS, TICK_SECONDS = 120, 10


class Missing(Enum):
    """What to do when a table's folder does not exist."""

    CREATE = "create"
    ERROR = "error"


@dataclass(frozen=True)
class Options:
    missing: Missing = Missing.CREATE
    writable: bool = True
    memtable_bytes: int = MEMTABLE_BYTES
    autocompact: bool = True
    compact_at: int = COMPACT_AT


class TidemarkError(Exception):
    """Base of all errors."""


class TableDoesNotExist(TidemarkError):
    pass


class TableClosed(TidemarkError):
    """A write to a table that is read-only or has shut down."""


class DataNotFound(TidemarkError):
    pass


class InvalidKey(TidemarkError):
    pass


class InvalidChecksum(TidemarkError):
    pass


class InvalidComponentId(TidemarkError):
    pass


class ComponentExists(TidemarkError):
    pass


class NoData(TidemarkError):
    """A component or a compaction would be empty."""


class Conflict(TidemarkError):
    """Another writer published the same manifest version first."""


def valid_key(key: str | Column = "key") -> Column:
    """True for keys that the formats can hold: not null, at most 255 bytes of UTF-8."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.octet_length(c) <= MAX_KEY_BYTES, F.lit(False))


def checked(df: DataFrame) -> DataFrame:
    """Fails the job, naming the key's length, if a key is null or too long."""
    n = F.coalesce(F.octet_length("key").cast("string"), F.lit("null"))
    return df.withColumn("key", F.when(valid_key(), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("invalid key, bytes: "), n)).cast("string")))


def ts_ns(ts: str | Column) -> Column:
    """Nanoseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) * F.lit(1000)


def ts_display(col: str | Column = "ts_ns") -> Column:
    """For display only: what is below a microsecond is cut off."""
    return F.timestamp_micros(F.floor((F.col(col) if isinstance(col, str) else col).cast("decimal(20)") / 1000).cast("long"))
