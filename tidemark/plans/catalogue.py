"""The query catalogue over the supplied tables: each query as DataFrame operations, and as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.model import MAX_KEY_BYTES, Options, ts_display
from tidemark.operators import merge as M
from tidemark.operators import stats as A
from tidemark.operators import upsert as U
from tidemark.plans.storage import fresh_path
from tidemark.sources import formats as R
from tidemark.sources.discovery import list_tables, located
from tidemark.store import Store

CUTOFF_US = 1706400000000000
EPOCH_US, SLICE_US = 1704067200000000, 345600000000
ORDER = ("us", "seq")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions of keys user/type, in eight components of four days each and three generations."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("key"), us.alias("us"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
    component = F.expr(f"cast((us - {EPOCH_US}) div {SLICE_US} as int)")
    return rows.withColumn("component", component).withColumn("generation", F.when(F.col("component") >= 5, 0).when(F.col("component") >= 3, 1).otherwise(2))


def okv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as writes in the order of their numbers, of which many come late."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value"))


def keys_frame(spark: SparkSession, *keys: str) -> DataFrame:
    """A local relation, whose size Spark knows: semi-joins with it are broadcast from the start."""
    return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.string())}))


def _kv(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(kv(spark, sf_dir))


def _okv(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(okv(spark, sf_dir))


def _winners(df: DataFrame) -> DataFrame:
    return M.lww(df.select("key", "us", "seq", "value"), order=ORDER).select("key", "us", "value")


def _replicas(df: DataFrame) -> DataFrame:
    held = F.filter(F.array(*map(F.lit, (0, 1, 2))), lambda r: F.pmod(F.col("seq"), F.lit(5)) != r)
    return M.merge_replicas(df.select("key", "us", F.explode(held).alias("r")), "r", "us")


def _uuid(df: DataFrame) -> DataFrame:
    s, n = F.expr("us div 1000000"), F.col("us") % 1000000 * 1000
    return df.select(S.component_id_column(s, n, F.col("generation"), F.lpad(F.col("seq").cast("string"), 16, "0")).alias("uuid"))


def _prune_key(df: DataFrame) -> DataFrame:
    return A.key_ranges(df.withColumn("component", F.substring("key", 1, 1)), "component", "us", "us", keys=False).filter(A.covers_key("46/click")).select("component")


def _parsed(df: DataFrame) -> DataFrame:
    return _uuid(df).select("uuid", S.parse_component_id_column("uuid").alias("id")).select("uuid", "id.*")


def _log_codec(df: DataFrame) -> DataFrame:
    """Each row as a write log's record, decoded again."""
    rows = df.select("seq", R.log_record(F.col("key"), F.col("us") * 1000, F.col("value")).alias("record"))
    return R.decode_log_records(rows).select("seq", "status", "key", "ts_ns", F.col("value").cast("string").alias("value"), F.lower(F.hex("checksum")).alias("checksum"))


def _index_codec(df: DataFrame) -> DataFrame:
    """The index of a component of all winners, decoded again."""
    rows = A.index_layout(_winners(df), ["us"])
    return R.decode_index_records(rows.select(R.index_record(F.col("key"), F.col("us") * 1000, F.col("start_off"), F.col("len")).alias("record")))


def _paths(df: DataFrame) -> DataFrame:
    """Index files of a cluster in which each event type is a table."""
    component = F.concat_ws("-", F.lit("1"), F.lit("0"), F.col("generation").cast("string"), F.col("component").cast("string"))
    path = F.concat_ws("/", F.lit("file:/data"), F.concat(F.lit("node"), F.col("seq") % 5), F.concat(F.lit("shard_"), S.shard("key", 128)), F.lit("ns"), F.element_at(F.split("key", "/"), 2), component, F.lit("index"))
    return located(df.select(path.alias("path"))).distinct()


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """events in a table of the store: a component for each four days, the oldest last, so that most writes are late; full generations compacted."""
    path = fresh_path(spark, "store")
    store = Store(spark, path, Options(compact_at=3))
    rows = kv(spark, sf_dir)
    for c in range(8):
        part = rows.filter(F.col("component") == F.lit(c * 3 % 8))
        store.upsert(part.select("key", (F.col("us") * 1000).alias("ts_ns"), F.col("value").cast("binary").alias("value"), "seq"))
    store.shutdown()
    return Store.readonly(spark, path)


def _store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).snapshot().select("key", "ts_ns", F.col("value").cast("string").alias("value"))


def _store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).stream_all(CUTOFF_US * 1000).select("key", "ts_ns", F.col("value").cast("string").alias("value"))


def _store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of the table: compaction has left no more rows than keys and components allow."""
    m = _stored(spark, sf_dir).manifest()
    return m.agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.max("max_ts_ns").alias("max_ts_ns"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lww_snapshot": _kv(_winners),
    "list_keys": _kv(lambda d: M.list_keys(d, ts="us")),
    "list_keys_newer": _kv(lambda d: M.newest(d, ts="us").filter(F.col("us") > CUTOFF_US)),
    "list_keys_newer_pushed": _kv(lambda d: M.list_keys(d, CUTOFF_US, "us")),
    "stream_all_newer": _kv(lambda d: M.stream_all(d.select("key", "us", "seq", "value"), CUTOFF_US, "us", ORDER).select("key", "us", "value")),
    "point_get": _kv(lambda d: M.get(d, "8/error", order=ORDER).select("key", "us", "value")),
    "multi_get": lambda s, d: M.get_many(kv(s, d), keys_frame(s, "8/error", "46/click", "nope/x"), ORDER).select("key", "us", "value"),
    "not_found": lambda s, d: M.not_found(keys_frame(s, "8/error", "nope/x"), kv(s, d)),
    "component_summary": _kv(lambda d: A.key_ranges(d, "component", "us", "us")),
    "generation_range": _kv(lambda d: A.key_ranges(d, "generation", "us", "us", keys=False)),
    "prune_key_range": _kv(_prune_key),
    "prune_newer": _kv(lambda d: A.key_ranges(d, "component", "us", "us", keys=False).filter(A.covers_newer(CUTOFF_US, "us")).select("component")),
    "compact_gen0": _kv(lambda d: M.lww(d.filter("generation = 0"), order=("us", "component", "seq")).select("key", "us", "value")),
    "compaction_delta": _kv(A.compaction_delta),
    "late_arrivals": _okv(lambda d: U.late(d, "ts").select("key", "ts", "seq")),
    "put_accepted": _okv(lambda d: U.accepted(d, "ts").select("key", "ts", "seq")),
    "tie_first_writer": _okv(lambda d: M.lww_first(d, ts="ts")),
    "checksum": lambda s, d: table(s, d, "documents").select("doc_id", S.md5hex("text").alias("md5")),
    "sparse_samples": _kv(A.sparse_samples),
    "index_layout": _kv(lambda d: A.index_layout(_winners(d), ["us"]).select("key", "us", "start_off", "len")),
    "wal_size": _kv(lambda d: A.log_layout(d, S.log_record_length("key", "value"))),
    "live_bytes": _kv(lambda d: A.live_bytes(_winners(d))),
    "cluster_merge": _kv(_replicas),
    "list_tables": lambda s, d: list_tables(table(s, d, "events"), "event_type"),
    "uuid_fmt": _kv(_uuid),
    "key_limit": lambda s, d: table(s, d, "documents").select("doc_id", S.byte_length("text").alias("n")).filter(F.col("n") <= MAX_KEY_BYTES),
    "conv_latest": lambda s, d: M.lww(table(s, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn", "text"]),
    "as_of": _kv(lambda d: M.as_of(d.select("key", "us", "seq", "value"), CUTOFF_US, "us", ORDER).select("key", "us", "value")),
    "covers_timestamp": _kv(lambda d: A.key_ranges(d, "component", "us", "us", keys=False).filter(A.covers_timestamp(CUTOFF_US, "us")).select("component")),
    "generation_roll_up": _kv(lambda d: A.roll_up(A.key_ranges(d.withColumn("us", F.col("us") * 1000), F.col("component"), "us", "ts_ns", keys=False).join(d.select("component", "generation").distinct(), "component"))),
    "value_file_bytes": _kv(lambda d: A.value_file_bytes(_winners(d))),
    "ts_display": _kv(lambda d: d.select("seq", F.unix_micros(ts_display(F.col("us") * 1000)).alias("shown_us"))),
    "uuid_parse": _kv(_parsed),
    "log_codec": _kv(_log_codec),
    "index_codec": _kv(_index_codec),
    "discovered": _kv(_paths),
    "store_snapshot": _store_snapshot,
    "store_stream_newer": _store_stream,
    "store_bounds": _store_manifest,
    "shard": _kv(lambda d: d.select("key").distinct().select("key", S.shard("key", 128).alias("shard"))),
}

_KV = f"""(select *, case when component >= 5 then 0 when component >= 3 then 1 else 2 end generation from
(select concat(cast(user_id as varchar), '/', event_type) as key, epoch_us(ts) us, event_id seq, props as value,
cast((epoch_us(ts) - {EPOCH_US}) // {SLICE_US} as int) component from events) e)"""
_OKV = "(select cast(o_custkey as varchar) as key, o_orderdate ts, o_orderkey seq, o_orderpriority as value from orders)"
_LWW = f"(select * from (select *, row_number() over (partition by key order by us desc, seq desc) rn from {_KV} kv) t where rn = 1)"
_EARLIER = f"(select *, max(ts) over (partition by key order by seq rows between unbounded preceding and 1 preceding) pm from {_OKV} okv)"
_BEFORE = "rows between unbounded preceding and 1 preceding"

SQL: dict[str, str] = {
    "lww_snapshot": f"select key, us, value from {_LWW} w",
    "list_keys": f"select key, us from {_LWW} w where us > 0",
    "list_keys_newer": f"select key, us from {_LWW} w where us > {CUTOFF_US}",
    "list_keys_newer_pushed": f"select key, max(us) us from {_KV} kv where us > {CUTOFF_US} group by key",
    "stream_all_newer": f"select key, us, value from {_LWW} w where us > {CUTOFF_US}",
    "point_get": f"select key, us, value from {_LWW} w where key = '8/error'",
    "multi_get": f"select w.key, us, value from {_LWW} w where key in ('8/error', '46/click', 'nope/x')",
    "not_found": f"select r.key from (values ('8/error'), ('nope/x')) r(key) where not exists (select 1 from {_KV} kv where kv.key = r.key)",
    "component_summary": f"select component, min(key) first_key, max(key) last_key, min(us) min_us, max(us) max_us, count(distinct key) key_count from {_KV} kv group by component",
    "generation_range": f"select generation, min(key) first_key, max(key) last_key, min(us) min_us, max(us) max_us from {_KV} kv group by generation",
    "prune_key_range": f"select component from (select substr(key, 1, 1) component, min(key) lo, max(key) hi from {_KV} kv group by substr(key, 1, 1)) t where '46/click' >= lo and '46/click' <= hi",
    "prune_newer": f"select component from (select component, max(us) mx from {_KV} kv group by component) t where mx >= {CUTOFF_US}",
    "compact_gen0": f"select key, us, value from (select *, row_number() over (partition by key order by us desc, component desc, seq desc) rn from {_KV} kv where generation = 0) t where rn = 1",
    "compaction_delta": f"""select a.generation, cast(n_in as bigint) n_in, n_out, cast(n_in - n_out as bigint) reclaimed from
        (select generation, sum(n) n_in from (select generation, component, count(distinct key) n from {_KV} kv group by generation, component) x group by generation) a
        join (select generation, count(distinct key) n_out from {_KV} kv group by generation) b on a.generation = b.generation""",
    "late_arrivals": f"select key, ts, seq from {_EARLIER} t where pm >= ts",
    "put_accepted": f"select key, ts, seq from {_EARLIER} t where pm is null or pm < ts",
    "tie_first_writer": f"select key, ts, seq, value from (select *, row_number() over (partition by key order by ts desc, seq asc) rn from {_OKV} okv) t where rn = 1",
    "checksum": "select doc_id, md5(text) as md5 from documents",
    "sparse_samples": f"""select key, idx_off from (select key, row_number() over (order by key) rn,
        cast(coalesce(sum(29 + strlen(key)) over (order by key {_BEFORE}), 0) as bigint) idx_off from (select distinct key from {_KV} kv) d) t where rn % 128 = 0""",
    "index_layout": f"select key, us, cast(coalesce(sum(16 + strlen(value)) over (order by key {_BEFORE}), 0) as bigint) as start_off, cast(strlen(value) as bigint) as len from {_LWW} w",
    "wal_size": f"""select seq, cast(39 + strlen(key) + strlen(value) as bigint) as rec_len,
        cast(sum(39 + strlen(key) + strlen(value)) over (order by seq rows between unbounded preceding and current row) as bigint) as end_off from {_KV} kv""",
    "live_bytes": f"select cast(sum(strlen(value)) as bigint) as memsize, count(*) as n from {_LWW} w",
    "cluster_merge": f"select key, max(us) us, count(distinct r) replicas from (select key, us, n.r from {_KV} kv cross join (values (0), (1), (2)) n(r) where seq % 5 <> n.r) t group by key",
    "list_tables": "select distinct event_type as table_name from events",
    "uuid_fmt": f"""select concat(cast(us // 1000000 as varchar), '-', lpad(cast(us % 1000000 * 1000 as varchar), 10, '0'), '-', cast(generation as varchar), '-', lpad(cast(seq as varchar), 16, '0')) as uuid from {_KV} kv""",
    "key_limit": "select doc_id, cast(strlen(text) as bigint) as n from documents where strlen(text) <= 255",
    "shard": f"select key, cast(('0x' || substr(md5(key), 1, 8))::bigint % 128 as int) shard from (select distinct key from {_KV} kv) d",
    "as_of": f"select key, us, value from (select *, row_number() over (partition by key order by us desc, seq desc) rn from {_KV} kv where us <= {CUTOFF_US}) t where rn = 1",
    "covers_timestamp": f"select component from (select component, min(us) lo, max(us) hi from {_KV} kv group by component) t where {CUTOFF_US} between lo and hi",
    "generation_roll_up": f"select generation, min(key) first_key, max(key) last_key, min(us) * 1000 min_ts_ns, max(us) * 1000 max_ts_ns from {_KV} kv group by generation",
    "value_file_bytes": f"select cast(sum(16 + strlen(value)) as bigint) as bytes from {_LWW} w",
    "ts_display": f"select seq, us as shown_us from {_KV} kv",
    "uuid_parse": f"""select concat(cast(us // 1000000 as varchar), '-', lpad(cast(us % 1000000 * 1000 as varchar), 10, '0'), '-', cast(generation as varchar), '-', lpad(cast(seq as varchar), 16, '0')) as uuid,
        us // 1000000 as seconds, us % 1000000 * 1000 as nanos, generation, lpad(cast(seq as varchar), 16, '0') as guid from {_KV} kv""",
    "log_codec": f"select seq, 'ok' as status, key, us * 1000 as ts_ns, value, md5(value) as checksum from {_KV} kv",
    "index_codec": f"select key, us * 1000 as ts_ns, cast(coalesce(sum(16 + strlen(value)) over (order by key {_BEFORE}), 0) as bigint) as start, cast(strlen(value) as bigint) as len from {_LWW} w",
    "discovered": f"""select distinct concat('node', seq % 5) as node, concat('shard_', ('0x' || substr(md5(key), 1, 8))::bigint % 128) as shard, 'ns' as namespace, split_part(key, '/', 2) as "table",
        concat('1-0-', generation, '-', component) as component, concat('file:/data/node', seq % 5, '/shard_', ('0x' || substr(md5(key), 1, 8))::bigint % 128, '/ns/', split_part(key, '/', 2), '/1-0-', generation, '-', component) as path from {_KV} kv""",
    "store_snapshot": f"select key, us * 1000 as ts_ns, value from {_LWW} w",
    "store_stream_newer": f"select key, us * 1000 as ts_ns, value from {_LWW} w where us > {CUTOFF_US}",
    "store_bounds": f"select min(key) first_key, max(key) last_key, max(us) * 1000 as max_ts_ns from {_KV} kv",
    "conv_latest": "select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc, text desc) rn from conversations) t where rn = 1",
}
