"""Checksums, component ids, layout sizes, shards."""

from __future__ import annotations

import re
import secrets
import string
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import InvalidComponentId

#: Fixed bytes of a record beside key and value: write log, index, value file.
LOG_FIXED, INDEX_FIXED, VALUE_FIXED = 39, 29, 16
#: Every so many keys an index has a sample.
SAMPLE_EVERY = 128


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5sum(value: str | Column) -> Column:
    """Raw 16-byte MD5 of a binary or string column."""
    return F.unhex(F.md5(_c(value).cast("binary")))


def md5hex(value: str | Column) -> Column:
    return F.md5(_c(value).cast("binary"))


def byte_length(c: str | Column) -> Column:
    return F.octet_length(_c(c)).cast("long")


def log_record_length(key: str | Column, value: str | Column) -> Column:
    return F.lit(LOG_FIXED) + byte_length(key) + byte_length(value)


def index_record_length(key: str | Column) -> Column:
    return F.lit(INDEX_FIXED) + byte_length(key)


def value_record_length(value: str | Column) -> Column:
    return F.lit(VALUE_FIXED) + byte_length(value)


def shard(key: str | Column, n: int) -> Column:
    """A shard number from 0 to n - 1, from the first 32 bits of the key's MD5: stable across runs and systems, and never negative."""
    return (F.conv(F.substring(F.md5(_c(key).cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def now_ns() -> int:
    return time.time_ns()


def current_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * F.lit(1000)


#: The component id that names no component: what a writer that stops leaves as its last.
SHUTDOWN_ID = f"{0}-{0:010d}-0-shutdown"


def random_guid(n: int = 16) -> str:
    return "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(n))


def component_id(ns: int, generation: int, guid: str | None = None) -> str:
    """seconds-nanos(10 digits)-generation-guid."""
    return f"{ns // 10**9}-{ns % 10**9:010d}-{generation}-{guid or random_guid()}"


def component_id_column(seconds: Column, nanos: Column, generation: Column, guid: Column) -> Column:
    return F.concat(seconds.cast("string"), F.lit("-"), F.lpad(nanos.cast("string"), 10, "0"), F.lit("-"), generation.cast("string"), F.lit("-"), guid)


def parse_component_id(text: str) -> tuple[int, int, str]:
    """(nanoseconds, generation, guid); the guid may hold dashes."""
    m = re.fullmatch(r"(\d+)-(\d+)-(\d+)-(.*)", text, re.DOTALL)
    if not m:
        raise InvalidComponentId(text)
    return int(m[1]) * 10**9 + int(m[2]), int(m[3]), m[4]


def parse_component_id_column(c: str | Column) -> Column:
    """A struct (seconds, nanos, generation, guid); null where a part is bad."""
    parts = F.split(_c(c), "-", 4)
    at = lambda i: F.try_element_at(parts, F.lit(i + 1))
    num = lambda i, kind: F.expr("null").cast(kind) if i < 0 else at(i).try_cast(kind)
    s, n, g, guid = num(0, "bigint"), num(1, "bigint"), num(2, "int"), at(3)
    return F.when(s.isNotNull() & n.isNotNull() & g.isNotNull() & guid.isNotNull(), F.struct(s.alias("seconds"), n.alias("nanos"), g.alias("generation"), guid.alias("guid")))


def lossy_text(value: str | Column) -> Column:
    """UTF-8 text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(_c(value).cast("binary").cast("string"))
