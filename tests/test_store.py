import random

import pytest
from pyspark.sql import functions as F

from tidemark import Options, Store
from tidemark.functions import scalar
from tidemark.model import Conflict, DataNotFound, InvalidKey, Missing, TableClosed, TableDoesNotExist
from tidemark.operators import merge as M
from tidemark.sources.discovery import cluster_list_keys, discover, list_tables
from tidemark.sources.formats import encode_component, encode_log_record, log_report, read_components, read_write_logs
from tidemark.streaming.upserts import changes, running_winners, upsert_stream

S = 10**9
SCHEMA = "key string, ts_ns long, value binary, seq long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, bytearray(v), i) for i, (k, t, v) in enumerate(rows)], SCHEMA)


def state(df):
    return {r["key"]: (r["ts_ns"], bytes(r["value"])) for r in df.collect()}


def test_overlapping_generations(spark):
    b = 1668185000
    parts = [(range(15), b), (range(20), b + 1), (range(5, 25), b + 2), (range(20, 30), b + 10)]
    sources = [frame(spark, [(f"key_{i:06}", (start + n) * S, b"v") for n, i in enumerate(keys)]) for keys, start in parts]
    got = {r["key"]: r["ts_ns"] // S for r in M.merge(sources).collect()}
    assert got == {f"key_{i:06}": b + 1 + i if i < 20 else b + i - 3 if i < 25 else b + i - 10 for i in range(30)}


def test_upserts_reopen_compact_and_vacuum(spark, tmp_path):
    rnd, want = random.Random(1), {}
    store = Store(spark, str(tmp_path / "t"), Options(autocompact=False))
    for batch in range(6):
        rows = [(f"k{rnd.randrange(40)}", rnd.randrange(1, 200), str(rnd.random()).encode()) for _ in range(60)]
        for k, t, v in rows:
            if t > want.get(k, (0, b""))[0]:
                want[k] = (t, v)
        store.upsert(frame(spark, rows))
        assert state(store.snapshot()) == want
    store = Store(spark, str(tmp_path / "t"), Options(missing=Missing.ERROR))
    before, version = state(store.snapshot()), store.version
    assert store.compact_candidate() == 0
    new, gone = store.compact(0)
    assert gone >= 0 and [c["component"] for c in store.components()] == [new]
    assert state(store.snapshot()) == before == want == state(store.snapshot(at=version))
    assert store.manifest().count() == 1 and store.vacuum() == [] and len(store.vacuum(0)) == 6
    cut = sorted(t for t, _ in want.values())[len(want) // 2]
    assert [(r["key"], r["ts_ns"]) for r in store.rows(cut)] == sorted((k, t) for k, (t, _) in want.items() if t > cut)
    assert store.list_keys(cut).count() == sum(t > cut for t, _ in want.values())
    k = next(iter(want))
    assert store.get(k) == want[k]
    with pytest.raises(DataNotFound):
        store.get("nope")
    rows, at = changes(store, cut)
    assert rows.count() == sum(t > cut for t, _ in want.values()) and at == max(t for t, _ in want.values())


def test_puts_logs_and_recovery(spark, tmp_path):
    path = str(tmp_path / "t")
    store = Store(spark, path)
    assert store.put("a", b"1", 10) and store.put("b", b"", 5) and not store.put("a", b"old", 10) and store.put("a", b"2", 11)
    assert store.get("a") == (11, b"2") and store.get("b") == (5, b"")
    again = Store(spark, path)  # as after a crash: the log is merged into a component
    assert state(again.snapshot()) == {"a": (11, b"2"), "b": (5, b"")}
    with pytest.raises(InvalidKey):
        again.put("x" * 256, b"", 1)
    assert again.put("x" * 255, b"", 1)
    again.shutdown()
    with pytest.raises(TableClosed):
        again.put("c", b"", 1)
    ro = Store.readonly(spark, path)
    assert ro.snapshot().count() == 3
    with pytest.raises(TableClosed):
        ro.upsert(frame(spark, [("q", 1, b"")]))
    with pytest.raises(TableDoesNotExist):
        Store.readonly(spark, str(tmp_path / "none"))
    with pytest.raises(Conflict):
        again._change(None, {"gone"})
    again.drop()
    assert not (tmp_path / "t").exists()


def test_ticks_flush_idle_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    assert store.tick() is None
    store.put("a", b"1", 10)
    assert store.tick() is None and store.pending.rows
    assert store.tick(store.pending.last_ns + 120 * S) is not None and not store.pending.rows and len(store.components()) == 1
    assert not any(n.endswith(".write_log") for n in store.files.names())


def test_vacuum_leaves_what_another_writer_is_about_to_publish(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "t"), Options(autocompact=False)) for _ in range(2))
    one.upsert(frame(spark, [("a", 1, b"x")]))
    unpublished = two._write(frame(spark, [("b", 2, b"y")]), 0)
    one.compact(0)
    assert one.vacuum() == [] and len(one.vacuum(0)) == 1
    two._change(unpublished)
    assert state(one.snapshot()) == {"a": (1, b"x"), "b": (2, b"y")}


def test_upsert_looks_only_at_components_that_may_hold_newer_rows(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t"), Options(autocompact=False))
    for k, t in (("a", 5), ("m", 50), ("z", 50)):
        store.upsert(frame(spark, [(k, t, b"1")]))
    read, looked = store._read, []
    monkeypatch.setattr(store, "_read", lambda cs: looked.append([c["first_key"] for c in cs]) or read(cs))
    store.upsert(frame(spark, [("a", 9, b"2"), ("n", 60, b"2"), ("m", 40, b"late")]))
    assert looked == [["m"]]
    assert state(store.snapshot()) == {"a": (9, b"2"), "m": (50, b"1"), "z": (50, b"1"), "n": (60, b"2")}


def test_recovery_orders_logs_and_sets_damaged_ones_aside(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    bad = bytearray(encode_log_record("x", 7, b"two"))
    bad[-3] ^= 1
    (d / "0002.write_log").write_bytes(encode_log_record("a", 5, b"second") + encode_log_record("b", 1, b"b"))
    (d / "0001.write_log").write_bytes(encode_log_record("c", 1, b"c") + encode_log_record("a", 5, b"first") + encode_log_record("a", 5, b"again")[:-4])
    (d / "0003.write_log").write_bytes(bytes(bad) + encode_log_record("b", 3, b"newer"))
    store = Store(spark, str(d))
    assert state(store.snapshot()) == {"a": (5, b"first"), "b": (3, b"newer"), "c": (1, b"c")}
    assert store.recovered == [("0001.write_log", "ok", 2), ("0001.write_log", "truncated", 1), ("0002.write_log", "ok", 2), ("0003.write_log", "bad_checksum", 1), ("0003.write_log", "ok", 1)]
    assert [n for n in store.files.names() if "write_log" in n] == ["0003.write_log.damaged"]
    assert Store(spark, str(d)).recovered == []


def test_bloom_filters_are_written_and_checksums_are_checked(spark, tmp_path):
    import pyarrow.parquet as pq

    store = Store(spark, str(tmp_path / "t"))
    store.upsert(frame(spark, [("a", 1, b"x"), ("b", 2, b"y")]))
    folder = tmp_path / "t" / store.components()[0]["path"]
    parts = sorted(folder.glob("*.parquet"))
    # the filter lies between the column data and the footer
    assert any(p.stat().st_size > pq.read_metadata(p).serialized_size + sum(pq.read_metadata(p).row_group(0).column(i).total_compressed_size for i in range(8)) + 64 for p in parts if pq.read_metadata(p).num_rows)
    rows = [r.asDict() for r in spark.read.parquet(str(folder)).collect()]
    for r in rows:
        r["checksum"] = bytearray(b"0" * 16)
    from tidemark.model import STORED, InvalidChecksum

    spark.createDataFrame(rows, STORED).coalesce(1).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(InvalidChecksum):
        store.get("a")


def test_hot_keys_are_cut_across_ranges(spark):
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(9)}", rnd.randrange(1, 500), b"") for _ in range(3000)]
    from tidemark.operators import upsert as U

    seen, want = {}, {}
    for i, (k, t, _) in enumerate(rows):
        want[i] = t > seen.get(k, 0)
        seen[k] = max(t, seen.get(k, 0))
    df = frame(spark, rows)
    assert {r["seq"] for r in U.accepted(df).collect()} == {i for i, ok in want.items() if ok}
    assert {r["seq"] for r in U.late(df).collect()} == {i for i, ok in want.items() if not ok}


def test_display_and_ids(spark):
    from tidemark.model import InvalidComponentId, ts_display

    row = spark.createDataFrame([(1668185010123456789, b"a\xffb")], "t long, v binary").select(ts_display("t").alias("t"), scalar.lossy_text("v").alias("v"), (scalar.current_ns() > 10**18).alias("now")).head()
    assert row["t"].isoformat().endswith(":30.123456") and row["v"] == "a\ufffdb" and row["now"]
    assert scalar.parse_component_id("5-0000000007-3-a-b") == (5 * S + 7, 3, "a-b") and scalar.parse_component_id(scalar.SHUTDOWN_ID)[2] == "shutdown"
    with pytest.raises(InvalidComponentId):
        scalar.parse_component_id("5-7-x")


def test_log_corruption(spark, tmp_path):
    good = encode_log_record("k1", 5 * S + 3, b"one")
    bad_sum = bytearray(encode_log_record("k2", 6, b"two"))
    bad_sum[-3] ^= 1
    bad_key = encode_log_record("ab", 7, b"x").replace(b"ab", b"\xff\xfe")
    tail = encode_log_record("k3", 8, b"three")
    (tmp_path / "1.write_log").write_bytes(good + bytes(bad_sum) + bad_key + tail + tail[:-5])
    (tmp_path / "2.write_log").write_bytes(good[:-2] + b"xx" + tail)
    (tmp_path / "3.write_log").write_bytes(b"")
    rows = read_write_logs(spark, str(tmp_path))
    assert sorted((r["key"], r["ts_ns"], bytes(r["value"])) for r in rows.collect()) == [("k1", 5 * S + 3, b"one"), ("k3", 8, b"three")]
    counts = {(r["log"][-11:-10], r["status"]): r["n"] for r in log_report(read_write_logs(spark, str(tmp_path), valid=False)).collect()}
    assert counts == {("1", "ok"): 2, ("1", "bad_checksum"): 1, ("1", "bad_key"): 1, ("1", "truncated"): 1, ("2", "bad_trailer"): 1}


def test_components_over_nodes(spark, tmp_path):
    for node, ts in (("n1", 5), ("n2", 9)):
        d = tmp_path / node / "shard_3" / "ns" / "events" / f"0000000001-0000000000-0-{node}"
        d.mkdir(parents=True)
        index, values = encode_component([("a", ts, b"v" + node.encode()), (f"only-{node}", 1, b"")])
        (d / "index").write_bytes(index)
        (d / "sstable").write_bytes(values)
    (tmp_path / "n1" / "shard_3" / "ns" / "other" / "x.writing").mkdir(parents=True)
    (tmp_path / "n1" / "shard_3" / "ns" / "other" / "x.writing" / "index").write_bytes(b"")
    assert [r["table_name"] for r in list_tables(discover(spark, str(tmp_path))).collect()] == ["events"]
    assert state(M.lww(read_components(spark, str(tmp_path)), order=("ts_ns", "component")))["a"] == (9, b"vn2")
    assert read_components(spark, str(tmp_path)).filter("valid").count() == 4
    got = {r["key"]: r["ts_ns"] for r in cluster_list_keys(spark, str(tmp_path), "events").collect()}
    assert got == {"a": 9, "only-n1": 1, "only-n2": 1}


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(f"k{rnd.randrange(9)}", rnd.randrange(1, 99), str(i).encode()) for i in range(90)]
    all_rows = frame(spark, rows)
    src = tmp_path / "in"
    for i in range(3):
        all_rows.filter(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    store = Store(spark, str(tmp_path / "t"), Options(compact_at=2))
    query = upsert_stream(stream, store, str(tmp_path / "cp"), {"availableNow": True})
    query.awaitTermination()
    newest = {k: max(t for x, t, _ in rows if x == k) for k, _, _ in rows}
    assert {k: t for k, (t, _) in state(store.snapshot()).items()} == newest
    q = running_winners(stream).writeStream.format("memory").queryName("winners").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["key"]: r["ts_ns"] for r in spark.table("winners").collect()} == newest


def test_filters_reach_the_scan(spark, tmp_path):
    frame(spark, [("a", 1, b"x")]).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan(M.lww(df).filter("key = 'a'")) and "EqualTo(key,a)" in plan(M.get(df, "a"))
    assert "GreaterThan(ts_ns,5)" in plan(M.list_keys(df, 5)) and "value" not in plan(M.list_keys(df, 5)).split("ReadSchema")[1]
