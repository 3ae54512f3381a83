"""The private file formats: write logs, and components of an index file and a value file.

Files are listed and read by Spark's binaryFile reader, so any store that Spark reads will do. Decoding runs on executors,
one file at a time; a file holds at most one memtable or one component.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import MAX_KEY_BYTES, InvalidKey

LOG_SCHEMA = "log string, seq long, status string, key string, ts_ns long, value binary, checksum binary"
INDEX_SCHEMA = "component string, row long, key string, ts_ns long, start long, len long"
_AFTER_KEY = struct.Struct(">QIQ")
_INDEX = struct.Struct(">QIQQ")
_NS = 10**9
_MAX_NS = 2**63 - 1


def encode_log_record(key: str, ts_ns: int, value: bytes) -> bytes:
    k = key.encode()
    if len(k) > MAX_KEY_BYTES:
        raise InvalidKey(f"{len(k)} bytes")
    return bytes([len(k)]) + k + _AFTER_KEY.pack(ts_ns // _NS, ts_ns % _NS, len(value)) + value + hashlib.md5(value).digest() + b"\r\n"


def _number(c: Column, size: int) -> Column:
    """A number that is not negative, as bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(c), 2 * size, "0"))


def log_record(key: Column, ts_ns: Column, value: Column) -> Column:
    """A write log's record as a column, equal to encode_log_record()."""
    body = value.cast("binary")
    return F.concat(_number(F.octet_length(key), 1), key.cast("binary"), _number(_div(ts_ns), 8), _number(ts_ns % _NS, 4), _number(F.octet_length(body), 8), body, F.unhex(F.md5(body)), F.lit(b"\r\n"))


def index_record(key: Column, ts_ns: Column, start: Column, length: Column) -> Column:
    """An index file's record as a column."""
    return F.concat(_number(F.octet_length(key), 1), key.cast("binary"), _number(_div(ts_ns), 8), _number(ts_ns % _NS, 4), _number(start, 8), _number(length, 8))


def _div(ts_ns: Column) -> Column:
    return F.call_function("div", ts_ns, F.lit(_NS))


def decode_log_records(df: DataFrame, record: str = "record") -> DataFrame:
    """status, key, ts_ns, value and checksum of the records in each value of a binary column, in place of it; other columns stay."""
    rest = [c for c in df.columns if c != record]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*r[1:], *x) for r in frame[[record, *rest]].itertuples(index=False, name=None) for x in decode_log(r[0])]
            yield pd.DataFrame(rows, columns=[*rest, "status", "key", "ts_ns", "value", "checksum"])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(record, *rest).mapInPandas(run, f"{kept + ', ' if kept else ''}status string, key string, ts_ns long, value binary, checksum binary")


def decode_index_records(df: DataFrame, record: str = "record") -> DataFrame:
    """key, ts_ns, start and len of the records in each value of a binary column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([x for r in frame[record] for x in decode_index(r)], columns=["key", "ts_ns", "start", "len"])

    return df.select(record).mapInPandas(run, "key string, ts_ns long, start long, len long")


def decode_log(data: bytes) -> Iterator[tuple]:
    """(status, key, ts_ns, value, checksum) of each record: ok, bad_checksum or bad_key (skipped, reading goes on), or a last truncated or bad_trailer, where reading stops."""
    at, end = 0, len(data)
    while at < end:
        n = data[at]
        head = at + 1 + n
        if head + _AFTER_KEY.size > end:
            yield "truncated", None, None, None, None
            return
        secs, nanos, size = _AFTER_KEY.unpack_from(data, head)
        body = head + _AFTER_KEY.size
        stop = body + size + 16
        if stop + 2 > end:
            yield "truncated", None, None, None, None
            return
        if data[stop : stop + 2] != b"\r\n":
            yield "bad_trailer", None, None, None, None
            return
        value, checksum, ns = data[body : body + size], data[stop - 16 : stop], secs * _NS + nanos
        key: str | None
        try:
            key = data[at + 1 : head].decode()
        except UnicodeDecodeError:
            key = None
        bad = "bad_key" if key is None else "bad_checksum" if hashlib.md5(value).digest() != checksum else "bad_timestamp" if ns > _MAX_NS else "ok"
        yield bad, key, ns if ns <= _MAX_NS else None, value, checksum
        at = stop + 2


def _files(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_write_logs(spark: SparkSession, path: str | list[str], valid: bool = True) -> DataFrame:
    """Records of all *.write_log files below path, seq counting within a log. valid=False keeps bad records, with their status."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, i, *r) for i, r in enumerate(decode_log(content))]
                yield pd.DataFrame(rows, columns=["log", "seq", "status", "key", "ts_ns", "value", "checksum"]).astype({"ts_ns": "Int64"})

    out = _files(spark, path, "*.write_log").mapInPandas(decode, LOG_SCHEMA)
    return out.filter("status = 'ok'").drop("status") if valid else out


def log_report(records: DataFrame) -> DataFrame:
    """Numbers of records of each status in each log."""
    return records.groupBy("log", "status").agg(F.count(F.lit(1)).alias("n"))


def decode_index(data: bytes) -> Iterator[tuple]:
    """(key, ts_ns, start, len) in file order; a record cut off at the end is left out."""
    at = 0
    while at < len(data):
        head = at + 1 + data[at]
        if head + _INDEX.size > len(data):
            return
        secs, nanos, start, size = _INDEX.unpack_from(data, head)
        yield data[at + 1 : head].decode("utf-8", "replace"), secs * _NS + nanos, start, size
        at = head + _INDEX.size


def encode_component(rows: list[tuple[str, int, bytes]]) -> tuple[bytes, bytes]:
    """(index, values) of rows (key, ts_ns, value) in key order."""
    index, values = bytearray(), bytearray()
    for key, ns, value in sorted(rows):
        k = key.encode()
        index += bytes([len(k)]) + k + _INDEX.pack(ns // _NS, ns % _NS, len(values), len(value))
        values += value + hashlib.md5(value).digest()
    return bytes(index), bytes(values)


def _component(path: str) -> str:
    return path.rstrip("/").rsplit("/", 2)[-2]


def read_indexes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Index rows of all components below path; folders still being written are skipped. Values are not read."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(_component(name), i, *r) for i, r in enumerate(decode_index(content))]
                yield pd.DataFrame(rows, columns=["component", "row", "key", "ts_ns", "start", "len"])

    return _files(spark, path, "index").filter(~F.col("path").rlike(r"\.writing/index$")).mapInPandas(decode, INDEX_SCHEMA)


def read_components(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of all components below path with their values: component, key, ts_ns, value, checksum, valid (the stored checksum holds)."""
    both = _files(spark, path, "{index,sstable}").filter(~F.col("path").rlike(r"\.writing/[a-z]+$")).withColumn("component", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        files = {p.rsplit("/", 1)[1]: c for p, c in zip(frame["path"], frame["content"], strict=True)}
        rows = []
        if len(files) == 2:
            values = files["sstable"]
            for key, ns, start, size in decode_index(files["index"]):
                value, checksum = values[start : start + size], values[start + size : start + size + 16]
                rows.append((frame["component"].iloc[0], key, ns, value, checksum, hashlib.md5(value).digest() == checksum))
        return pd.DataFrame(rows, columns=["component", "key", "ts_ns", "value", "checksum", "valid"])

    return both.groupBy("folder").applyInPandas(decode, "component string, key string, ts_ns long, value binary, checksum binary, valid boolean")
