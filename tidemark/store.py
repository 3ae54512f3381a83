"""A table on any file system that Spark writes: immutable sorted components and a versioned manifest.

Versions are published by creating the next numbered manifest file, which only one writer can do. Readers keep the version
they opened, so a compaction never changes a running read; retired components go with vacuum().
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import component_id, md5sum, now_ns
from tidemark.model import IDLE_SECONDS, MANIFEST, MAX_KEY_BYTES, STORED, ComponentExists, Conflict, DataNotFound, InvalidChecksum, InvalidKey, Missing, NoData, Options, TableClosed, TableDoesNotExist, checked
from tidemark.operators import merge as M
from tidemark.operators.upsert import effective
from tidemark.sources.formats import encode_log_record, log_report, read_write_logs

#: Of equal timestamps the component published last wins.
ORDER = ("ts_ns", "ordinal", "seq")


class _Files:
    """The few file operations that a table needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """Fails if the file is there."""
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(data))
        stream.close()

    def opened(self, name: str):
        """A stream whose hflush() makes what was written visible; the local file system's checksums would hold it back."""
        fs = self.fs
        if fs.getUri().getScheme() == "file":
            fs = self.jvm.org.apache.hadoop.fs.FileSystem.getLocal(fs.getConf()).getRawFileSystem()
        return fs.create(self.path(name), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class _Pending:
    """Single writes since the last flush: the newest of each key, and their log."""

    rows: dict[str, tuple[int, bytes, int]] = field(default_factory=dict)
    bytes: int = 0
    log: str | None = None
    stream: object = None
    last_ns: int = 0


class Store:
    """One table. Batches go in by upsert(), single rows by put(); reads are DataFrames over one manifest version."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.options, self.closed = spark, options, False
        self.files = _Files(spark, path)
        if not self.files.exists():
            if options.missing is Missing.ERROR or not options.writable:
                raise TableDoesNotExist(path)
            self.files.fs.mkdirs(self.files.path(""))
        self.pending = _Pending()
        #: (log, status, number) of the records that recovery found when the table was opened.
        self.recovered: list[tuple[str, str, int]] = []
        if options.writable:
            self._recover()

    @classmethod
    def readonly(cls, spark: SparkSession, path: str) -> Store:
        return cls(spark, path, Options(missing=Missing.ERROR, writable=False, autocompact=False))

    def __repr__(self) -> str:
        return f"Store({self.files.root}, version {self.version}, {len(self.components())} components)"

    # manifest

    @property
    def version(self) -> int:
        return max((int(n[1:-5]) for n in self.files.names("_manifest") if n.startswith("v") and n.endswith(".json")), default=0)

    def components(self, version: int | None = None) -> list[dict]:
        v = self.version if version is None else version
        return json.loads(self.files.read(f"_manifest/v{v:012d}.json"))["components"] if v else []

    def manifest(self) -> DataFrame:
        rows = [tuple(c[f.name] for f in MANIFEST.fields) for c in self.components()]
        return self.spark.createDataFrame(rows, MANIFEST)

    def _publish(self, base: int, components: list[dict]) -> None:
        try:
            self.files.create(f"_manifest/v{base + 1:012d}.json", json.dumps({"components": components}).encode())
        except Exception as e:
            if self.files.exists(f"_manifest/v{base + 1:012d}.json"):
                raise Conflict(f"version {base + 1} exists") from e
            raise

    def _change(self, added: dict | None, retired: set[str] = frozenset()) -> None:
        """Publishes again on top of newer versions, unless another writer has retired the same components."""
        while True:
            base = self.version
            now = self.components(base)
            if missing := retired - {c["component"] for c in now}:
                raise Conflict(f"already retired: {sorted(missing)}")
            if added and any(c["component"] == added["component"] for c in now):
                raise ComponentExists(added["component"])
            new = [{**added, "ordinal": 1 + max((c["ordinal"] for c in now), default=0)}] if added and added["ordinal"] is None else [added] if added else []
            try:
                return self._publish(base, [c for c in now if c["component"] not in retired] + new)
            except Conflict:
                continue

    # reads

    def _read(self, components: list[dict]) -> DataFrame:
        """Stored rows; the ordinal is the manifest's, as it is known only when a component is published."""
        if not components:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(STORED).parquet(*(f"{self.files.root}/{c['path']}" for c in components))
        ordinals = self.spark.createDataFrame([(c["component"], c["ordinal"]) for c in components], "component string, ordinal long")
        return rows.drop("ordinal").join(F.broadcast(ordinals), "component").select(*rows.columns)

    def versions(self, newer_than: int | None = None, key: str | None = None, at: int | None = None) -> DataFrame:
        """All stored versions, without components whose bounds rule them out."""
        found = [c for c in self.components(at) if (newer_than is None or c["max_ts_ns"] >= newer_than) and (key is None or c["first_key"] <= key <= c["last_key"])]
        rows = self._read(found)
        if self.pending.rows:
            held = [(k, ts, bytearray(v), n, None, -1, "pending", 2**62) for k, (ts, v, n) in self.pending.rows.items()]
            rows = rows.unionByName(self.spark.createDataFrame(held, STORED))
        return rows

    def snapshot(self, at: int | None = None) -> DataFrame:
        return M.lww(self.versions(at=at), order=ORDER).select("key", "ts_ns", "value")

    def stream_all(self, newer_than: int | None = None) -> DataFrame:
        """Keys in order with their newest version, if that is after newer_than; one consistent version of the table."""
        return M.stream_all(self.versions(newer_than).select("key", "ts_ns", "value", "ordinal", "seq"), newer_than, order=ORDER).select("key", "ts_ns", "value").orderBy("key")

    def rows(self, newer_than: int | None = None) -> Iterator:
        return self.stream_all(newer_than).toLocalIterator(prefetchPartitions=True)

    def list_keys(self, newer_than: int | None = None) -> DataFrame:
        return M.list_keys(self.versions(newer_than), newer_than).orderBy("key")

    def get(self, key: str) -> tuple[int, bytes]:
        if key in self.pending.rows:
            ts, value, _ = self.pending.rows[key]
            return ts, value
        row = M.get(self.versions(key=key), key, order=ORDER).withColumn("fits", F.coalesce(md5sum("value") == F.col("checksum"), F.lit(True))).head()
        if row is None:
            raise DataNotFound(key)
        if not row["fits"]:
            raise InvalidChecksum(key)
        return row["ts_ns"], bytes(row["value"])

    def get_many(self, wanted: DataFrame) -> DataFrame:
        return M.get_many(self.versions(), wanted, order=ORDER).select("key", "ts_ns", "value")

    # writes

    def _check_writable(self) -> None:
        if self.closed or not self.options.writable:
            raise TableClosed(self.files.root)

    def put(self, key: str, value: bytes, ts_ns: int) -> bool:
        """Logs and holds one row; False if an equal or newer version of the key is there, which is not an error."""
        self._check_writable()
        if len(key.encode()) > MAX_KEY_BYTES:
            raise InvalidKey(f"{len(key.encode())} bytes")
        held = self.pending.rows.get(key)
        if held is None:
            stored = M.newest(self.versions(newer_than=ts_ns, key=key).filter(F.col("key") == key)).head()
            held = stored and (stored["ts_ns"], b"", 0)
        if held and held[0] >= ts_ns:
            return False
        if self.pending.stream is None:
            self.pending.log = f"{component_id(now_ns(), 0)}.write_log"
            self.pending.stream = self.files.opened(self.pending.log)
        self.pending.stream.write(bytearray(encode_log_record(key, ts_ns, value)))
        self.pending.stream.hflush()
        if key in self.pending.rows:
            self.pending.bytes -= len(self.pending.rows[key][1])
        self.pending.rows[key] = (ts_ns, value, len(self.pending.rows))
        self.pending.bytes += len(value)
        self.pending.last_ns = now_ns()
        if self.pending.bytes >= self.options.memtable_bytes:
            self.flush()
        return True

    def sync(self) -> None:
        """Puts what was logged so far on the disks themselves, where the file system can."""
        if self.pending.stream is not None:
            self.pending.stream.hsync()

    def tick(self, at_ns: int | None = None) -> str | None:
        """What is due from time to time, every TICK_SECONDS say: the log is synced; rows held for IDLE_SECONDS without another put
        are flushed; generations that are full are compacted. The id of a component that a flush made."""
        self._check_writable()
        self.sync()
        if self.pending.rows and (at_ns or now_ns()) - self.pending.last_ns >= IDLE_SECONDS * 10**9:
            return self.flush()
        self._autocompact()
        return None

    def flush(self) -> str | None:
        """Publishes the held rows as a component of generation 0."""
        if not self.pending.rows:
            return None
        self._check_writable()
        held = [(k, ts, bytearray(v), n) for k, (ts, v, n) in self.pending.rows.items()]
        new = self._write(self.spark.createDataFrame(held, "key string, ts_ns long, value binary, seq long").coalesce(1), 0)
        self._change(new)
        self.pending.stream.close()
        self.files.delete(self.pending.log)
        self.pending = _Pending()
        self._autocompact()
        return new["component"]

    def upsert(self, batch: DataFrame, filter_late: bool = True) -> str | None:
        """Publishes the rows (key, ts_ns, value, seq) of batch that are newer than the table; of equal timestamps the first seq stays.

        filter_late=False spares the look at the table and only appends: reads come out the same, except that of equal
        timestamps the later component wins.
        """
        self._check_writable()
        self.flush()
        rows = M.lww_first(checked(batch.select("key", "ts_ns", "value", "seq")))
        if filter_late and (now := self.components()):
            # a component that ends before the batch begins, in time or in keys, makes no row late
            lo, hi, oldest = batch.agg(F.min("key"), F.max("key"), F.min("ts_ns")).head()
            may = [c for c in now if oldest is not None and c["max_ts_ns"] >= oldest and c["first_key"] <= hi and c["last_key"] >= lo]
            rows = effective(rows, self._read(may).select("key", "ts_ns")) if may else rows
        try:
            new = self._write(rows, 0)
        except NoData:
            return None
        self._change(new)
        self._autocompact()
        return new["component"]

    def _write(self, rows: DataFrame, generation: int, name: str | None = None, ordinal: int | None = None) -> dict:
        """Writes a component, dealt out and sorted by key so that footers' bounds prune, and measures it."""
        name = name or component_id(now_ns(), generation)
        path = f"components/{name}"
        if self.files.exists(path):
            raise ComponentExists(name)
        full = rows.select("key", "ts_ns", "value", "seq", md5sum("value").alias("checksum"), F.lit(generation).alias("generation"), F.lit(name).alias("component"), F.lit(None).cast("long").alias("ordinal"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions")) if generation else None
        ranged = full.repartitionByRange(parts, "key") if parts else full.repartitionByRange("key")
        ranged.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.files.root}/{path}")
        s = self.spark.read.parquet(f"{self.files.root}/{path}").agg(F.min("key"), F.max("key"), F.min("ts_ns"), F.max("ts_ns"), F.count(F.lit(1)), F.sum(F.octet_length("value").cast("long"))).head()
        if not s[4]:
            self.files.delete(path)
            raise NoData(name)
        return {"component": name, "generation": generation, "ordinal": ordinal, "first_key": s[0], "last_key": s[1], "min_ts_ns": s[2], "max_ts_ns": s[3], "key_count": s[4], "value_bytes": s[5], "created_ns": now_ns(), "path": path}

    # compaction

    def compact_candidate(self, threshold: int | None = None) -> int | None:
        """The newest generation with enough components."""
        counts: dict[int, int] = {}
        for c in self.components():
            counts[c["generation"]] = counts.get(c["generation"], 0) + 1
        return min((g for g, n in counts.items() if n >= (threshold or self.options.compact_at)), default=None)

    def compact(self, generation: int) -> tuple[str, int]:
        """Merges all components of a generation into one of the next; its id and how many rows went. Reads see no change: it keeps the greatest ordinal of what it replaces."""
        self._check_writable()
        old = [c for c in self.components() if c["generation"] == generation]
        if not old:
            raise NoData(f"generation {generation}")
        new = self._write(M.lww(self._read(old), order=ORDER), generation + 1, ordinal=max(c["ordinal"] for c in old))
        self._change(new, {c["component"] for c in old})
        return new["component"], sum(c["key_count"] for c in old) - new["key_count"]

    def _autocompact(self) -> None:
        while self.options.autocompact and (g := self.compact_candidate()) is not None:
            self.compact(g)

    def vacuum(self, grace_seconds: float = 600) -> list[str]:
        """Deletes components that were retired more than grace_seconds ago; readers of older versions must be done by then.

        Only what some version named and the newest does not is retired: a folder that no version has named yet belongs to a
        writer that is about to publish it, and stays.
        """
        versions = {v: {c["component"] for c in self.components(v)} for v in range(1, self.version + 1)}
        live = versions.get(self.version, set())
        retired: dict[str, int] = {}
        for v, names in versions.items():
            for n in versions.get(v - 1, set()) - names:
                retired[n] = v
        modified = lambda v: self.files.fs.getFileStatus(self.files.path(f"_manifest/v{v:012d}.json")).getModificationTime()
        due = now_ns() / 1e6 - 1000 * grace_seconds
        gone = [n for n in self.files.names("components") if n in retired and n not in live and modified(retired[n]) <= due]
        for n in gone:
            self.files.delete(f"components/{n}")
        return gone

    # lifecycle

    def _recover(self) -> None:
        """Merges write logs left behind into a component, in the order of their names: of equal timestamps the first record stays.

        Numbers of records of each status are kept in self.recovered. A log whose last record is cut off, as by a crash, is
        deleted like a whole one; one with damaged records is set aside as *.damaged.
        """
        logs = [n for n in self.files.names() if n.endswith(".write_log")]
        if not logs:
            return
        paths = [f"{self.files.root}/{n}" for n in logs]
        records = read_write_logs(self.spark, paths, valid=False).withColumn("log", F.regexp_extract("log", "([^/]+)$", 1))
        self.recovered = sorted(tuple(r) for r in log_report(records).collect())
        order = self.spark.createDataFrame([(n, i << 40) for i, n in enumerate(logs)], "log string, base long")
        rows = records.filter("status = 'ok'").join(F.broadcast(order), "log").select("key", "ts_ns", "value", (F.col("base") + F.col("seq")).alias("seq"))
        try:
            new = self._write(effective(M.lww_first(rows), self.versions().select("key", "ts_ns")), 0)
            self._change(new)
        except NoData:
            pass
        damaged = {n for n, status, _ in self.recovered if status not in ("ok", "truncated")}
        for n in logs:
            if n in damaged:
                self.files.fs.rename(self.files.path(n), self.files.path(f"{n}.damaged"))
            else:
                self.files.delete(n)

    def shutdown(self) -> None:
        if not self.closed and self.options.writable:
            self.flush()
        self.closed = True

    def drop(self) -> None:
        self.closed = True
        self.files.delete("")
