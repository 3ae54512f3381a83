"""URL filter: rules by host and path, then a blocked Bloom filter in front of an exact join with listed URLs.

Nulls and strings without "://": host and path are empty, no rule fits, and the verdict is allow. An empty list, or an
empty table of pages, gives no hit. Repeated rows stay. Only the URL column is read; other columns pass through untouched, whatever
their names, but for host, path, rule and verdict, which judge() replaces, and the column that listed() adds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, lower_ascii

#: 512-bit blocks of eight words, one bit of each word for a key, and the bits spent on a listed URL.
WORDS, BITS_A_KEY = 8, 16
#: The filter is broadcast up to this many bytes; a larger one is joined by block.
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Rule:
    """Fits a host, its subdomains, and paths that start with path."""

    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host without a leading www., and path without closing slashes; scheme, query and fragment don't count. Null for an empty host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_name(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)).otherwise(out)
    return out


def _bits(h: Column) -> list[Column]:
    """For each word of a block, the one bit that a key sets, from six bits of its second hash."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table of blocks (block, w0 to w7): one partial aggregate, then one row for each block in use."""
    h = F.xxhash64(key, F.lit(7))
    rows = keys.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(h))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def listed(df: DataFrame, key: str, listing: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, out: str = "is_listed") -> DataFrame:
    """Adds whether key, a canonical URL, is in listing (a column url of canonical URLs, nulls and repeats allowed).

    The filter spares most rows the shuffle: those it passes are joined exactly, so a false positive changes nothing.
    The hits of the join are few; they come back by the key.
    """
    u, block, probe, hit_mark, *words = fresh([*df.columns, out], "_u", "_block", "_probe", "_hit", *(f"w{i}" for i in range(WORDS)))
    keys = listing.select(F.col("url").alias(u)).filter(F.col(u).isNotNull()).distinct()
    n = keys.count()
    n_blocks = max(1, -(-n * BITS_A_KEY // 512))
    blocks = bloom_blocks(keys, u, n_blocks).toDF(block, *words)
    if n_blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    h = F.xxhash64(key, F.lit(7))
    passes = F.lit(True)
    for w, b in zip(words, _bits(h), strict=True):
        passes = passes & (F.col(w).bitwiseAND(b) != 0)
    # rows without a key need no filter, and would all meet in one task where it is joined by shuffle
    asked = df.filter(F.col(key).isNotNull())
    marked = asked.withColumn(block, F.pmod(F.xxhash64(key), F.lit(n_blocks))).join(blocks, block, "left").withColumn(probe, F.when(passes, F.col(key)))
    marked = marked.select(*df.columns, probe)
    hit = marked.filter(F.col(probe).isNotNull()).join(keys.withColumn(hit_mark, F.lit(True)), F.col(probe) == F.col(u), "left")
    hit = hit.select(*df.columns, F.coalesce(hit_mark, F.lit(False)).alias(out))
    rest = marked.filter(F.col(probe).isNull()).select(*df.columns).unionByName(df.filter(F.col(key).isNull()))
    return hit.unionByName(rest.withColumn(out, F.lit(False)))


def judge(pages: DataFrame, rules: Sequence[Rule], listing: DataFrame, url: str = "url", **kw) -> DataFrame:
    """Adds host, path, rule and verdict (allow or block); columns of pages with those names are replaced."""
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url]
    name, found = fresh([*keep, "host", "path", "rule", "verdict"], "_canonical", "_listed")
    df = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = df.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules)).withColumn(name, F.when(F.col("rule").isNull(), canonical(F.col("host"), F.col("path"))))
    df = listed(df, name, listing, out=found, **kw)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.name, F.lit("block" if r.block else "allow")).otherwise(by_rule)
    return df.withColumn("verdict", F.coalesce(by_rule, F.when(F.col(found), F.lit("block")).otherwise(F.lit("allow")))).drop(name, found)
