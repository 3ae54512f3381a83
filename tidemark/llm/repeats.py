"""Repeated byte strings: each byte that lies in a string of `length` bytes which also starts earlier is removed.

Suffixes are ordered by a difference cover, only as deep as the answer needs. Of the positions of each document those are
sampled whose remainders lie in a difference cover of PERIOD: of any two positions, some shift below PERIOD takes both to
sampled ones. Equal strings of `length` bytes therefore share two sampled suffixes that agree in the first length - PERIOD
+ 1 bytes. So:

1. Sampled suffixes are named by that prefix and sorted by name. Names that occur once are dropped. A name spans the
   sampled suffix as far as it matters, so no recursion on names is needed.
2. The remaining suffixes are those at most PERIOD - 1 bytes before a sample that is left. They are named by their first
   `length` bytes and merged in the order of names and then of positions; each whose prefix equals that of the one before
   it is a repeat.

Names travel as packed arrays, one for each chunk of text and range of names, not as rows. Names of step 1 may collide, which
costs time only; those of step 2 are hashes of about 62 bits. A text that occurs more than once takes part once, as its
first document; the other copies are repeats from end to end.

Documents are ordered by doc_id, nulls last, and then by their text's digest. Null texts are empty. A repeat inside one
document counts, overlapping or not. Of rows that are equal in doc_id and text one is first. An empty table gives an empty one.
Other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import spark_parts
from tidemark.llm.shingles import U, mix, prefix_hashes
from tidemark.plans.ordered import with_running
from tidemark.plans.storage import remove, scoped, written

#: A perfect difference set modulo 57.
PERIOD, COVER = 57, np.array([0, 1, 3, 13, 32, 36, 43, 52])
#: Bytes of text of a chunk, and rows of a table of keys that is broadcast at most.
CHUNK, BROADCAST_ROWS = 1 << 19, 500_000
#: Bytes of text whose names meet in one part, about; names are about as long as the text, or shorter.
PART_BYTES = 1 << 26


def _pack(ascending: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as planes of bytes of their differences, most of which are zero and compress."""
    d = np.diff(ascending, prepend=0).astype("<u4")
    return d.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _samples(size: int, prefix: int) -> int:
    """How many sampled positions of a document have a whole prefix after them."""
    n = size - prefix + 1
    return 0 if n <= 0 else n // PERIOD * len(COVER) + int(np.searchsorted(COVER, n % PERIOD))


def _place(ordinal: np.ndarray) -> np.ndarray:
    return ordinal // len(COVER) * PERIOD + COVER[ordinal % len(COVER)]


def _hashes(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return mix((sums[at + width] - sums[at]) * inverse[at])


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places where it stands, in their order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for run in np.split(order, cuts):
        if len(run):
            yield int(part[run[0]]), run


def _named_samples(prefix: int, parts: int):
    """Chunks of documents to rows (part, chunk, kind, data): kind 0 lists a chunk's documents, kind 1 has names and ordinals of samples."""

    def chunk(keys: list[bytes], texts: list[bytes]) -> list[tuple]:
        number = int.from_bytes(hashlib.blake2b(b"".join(keys), digest_size=8).digest(), "big", signed=True)
        sizes = np.array([len(t) for t in texts])
        sums, inverse = prefix_hashes(np.frombuffer(b"".join(texts), np.uint8))
        starts = np.cumsum(sizes) - sizes
        at = np.concatenate([_place(np.arange(_samples(int(n), prefix))) + s for n, s in zip(sizes, starts, strict=True)]).astype(np.int64)
        rows = [(number % parts, number, 0, b"".join(keys) + sizes.astype("<u4").tobytes())]
        if len(at):
            h = _hashes(sums, inverse, at, prefix)
            for p, run in _split(((h >> U(40)) % U(parts)).astype(np.int32)):
                rows.append((p, number, 1, h[run].astype("<u4").tobytes() + _pack(run)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= CHUNK:
                    yield _rows(chunk(keys, texts))
                    keys, texts, size = [], [], 0
        if keys:
            yield _rows(chunk(keys, texts))

    return run


_KINDS = (("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()))
_ROW = "part int, chunk long, kind int, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])


def _repeated_samples(table: pa.Table) -> pa.Table:
    """Of one part: the ordinals of samples whose name occurs again, by chunk; lists of documents pass through."""
    part, out, names, rest = 0, [], [], []
    for p, c, kind, data in zip(*(table.column(n).to_pylist() for n, _ in _KINDS), strict=True):
        part = p
        if kind == 0:
            out.append((p, c, 0, data))
        else:
            names.append(np.frombuffer(data, "<u4", len(data) // 8))
            rest.append((c, data))
    if names:
        flat = np.concatenate(names)
        ordered = np.sort(flat)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        for own, (c, data) in zip(names, rest, strict=True):
            if len(again):
                hit = again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own
                if hit.any():
                    out.append((part, c, 1, _pack(_unpack(data[4 * len(own) :])[hit])))
    return pa.Table.from_batches([_rows(out)])


def _by_document(prefix: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one chunk: for each document with samples left, their ordinals."""
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        listing = data[kinds.index(0)]
        n = len(listing) // 36
        counts = np.array([_samples(int(s), prefix) for s in np.frombuffer(listing, "<u4", n, 32 * n)], np.int64)
        ends = np.cumsum(counts)
        found = [_unpack(d) for k, d in zip(kinds, data, strict=True) if k == 1]
        found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        owner = np.searchsorted(ends, found, side="right")
        keys, left = [], []
        for d, run in _split(owner):
            keys.append(listing[32 * d : 32 * d + 32])
            left.append(_pack(found[run] - (ends[d] - counts[d])))
        return pa.table({"sha": pa.array(keys, pa.binary()), "left": pa.array(left, pa.binary())})

    return run


def _packed_chunk(key: tuple, texts: pa.Table, lists: pa.Table) -> pa.Table:
    """One row for a chunk of documents, in order, with what samples each has left."""
    text = dict(zip(texts.column("sha").to_pylist(), texts.column("body").to_pylist(), strict=True))
    order = sorted(range(lists.num_rows), key=lambda i: lists.column("place")[i].as_py())
    shas = [lists.column("sha")[i].as_py() for i in order]
    out = pa.table({"sha": pa.array(shas, pa.binary()), "body": pa.array([text[s] for s in shas], pa.binary()), "left": pa.array([lists.column("left")[i].as_py() for i in order], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(out)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


class _Chunk:
    """The strings of a chunk that may repeat: where they start, and for the first of each in the chunk, its name and part."""

    def __init__(self, data: bytes, length: int, parts: int):
        table = pa.ipc.open_file(pa.BufferReader(data)).read_all()
        self.shas, self.texts = table.column("sha").to_pylist(), table.column("body").to_pylist()
        # a byte between documents keeps their runs apart
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        buffer = np.frombuffer(b"\0".join(self.texts) + b"\0", np.uint8)
        self.buffer = buffer
        edges = np.zeros(len(buffer) + 1, np.int32)
        for start, size, left in zip(self.starts, self.sizes, table.column("left").to_pylist(), strict=True):
            at = _place(_unpack(left))
            lo, hi = np.maximum(0, at - PERIOD + 1), np.minimum(at, size - length) + 1
            lo, hi = lo[lo < hi], hi[lo < hi]
            np.add.at(edges, lo + start, 1)
            np.add.at(edges, hi + start, -1)
        self.at = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
        sums, inverse = prefix_hashes(buffer)
        h = _hashes(sums, inverse, self.at, length)
        order = np.argsort(h, kind="stable")
        again = np.r_[False, h[order][1:] == h[order][:-1]] if len(h) else np.zeros(0, bool)
        self.repeat = np.zeros(len(h), bool)
        self.repeat[order] = again
        self.first = np.flatnonzero(~self.repeat)
        names = h[self.first]
        self.parts = [(p, run, names[run]) for p, run in _split((names >> U(56) << U(8) | names & U(0xFF)).astype(np.int64) % parts)]

    def kept(self, length: int) -> Iterator[tuple[bytes, int, int, str]]:
        """(sha, bytes removed, runs removed, digest of what is left) of each document."""
        edges = np.zeros(len(self.buffer) + 1, np.int32)
        at = self.at[self.repeat]
        edges[at] += 1
        edges[at + length] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        for sha, start, size in zip(self.shas, self.starts, self.sizes, strict=True):
            g = gone[start : start + size]
            runs = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if size else 0
            yield sha, int(g.sum()), runs, hashlib.sha256(self.buffer[start : start + size][~g].tobytes()).hexdigest()


def _sent_names(length: int, parts: int):
    """Each name as seven bytes beside its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(p, number, 1, np.ascontiguousarray((names >> U(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()) for p, _, names in _Chunk(data.as_py(), length, parts).parts]
                yield _rows(rows)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Of one part: a bit for each name of each chunk, set if an earlier chunk has it. Names are merged in the order of chunks."""
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("data").to_pylist(), strict=True))
    part = table.column("part")[0].as_py()
    counts = [len(d) // 7 for _, d in rows]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :7] = np.frombuffer(b"".join(d for _, d in rows), np.uint8).reshape(-1, 7)
    names = wide.view("<u8").ravel()
    later = np.ones(len(names), bool)
    later[np.unique(names, return_index=True)[1]] = False
    out = [(part, c, 2, np.packbits(bits).tobytes()) for (c, _), bits in zip(rows, np.split(later, np.cumsum(counts)[:-1]), strict=True)]
    return pa.Table.from_batches([_rows(out)])


def _judged(length: int, parts: int):
    def run(chunks: pa.Table, bits: pa.Table) -> pa.Table:
        out = []
        said = dict(zip(bits.column("part").to_pylist(), bits.column("data").to_pylist(), strict=True))
        for data in chunks.column("data"):
            chunk = _Chunk(data.as_py(), length, parts)
            for p, run, _ in chunk.parts:
                later = np.unpackbits(np.frombuffer(said[p], np.uint8), count=len(run)).astype(bool)
                chunk.repeat[chunk.first[run[later]]] = True
            out += list(chunk.kept(length))
        return pa.table({"sha": pa.array([r[0] for r in out], pa.binary()), "n_removed": pa.array([r[1] for r in out], pa.int64()), "n_spans": pa.array([r[2] for r in out], pa.int64()), "kept_sha256": pa.array([r[3] for r in out], pa.string())})

    return run


_JUDGED = "sha binary, n_removed long, n_spans long, kept_sha256 string"


def _release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done, as soon as its driver has dropped what refers to them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@scoped
def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs. length must be at least PERIOD + 8."""
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    spark, prefix = docs.sparkSession, length - PERIOD + 1
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    source = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"))
    rows = written(source.select("doc_id", "sha", F.octet_length("body").cast("long").alias("n_bytes")).groupBy("sha", "doc_id").agg(F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")), "rows")
    firsts = written(rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("n_bytes").alias("size")), "firsts")

    # parts follow the bytes, so that what one task holds does not grow with the input
    total = firsts.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    parts = max(8, spark_parts(docs), -(-total // PART_BYTES))

    # texts that take part: the first of each, if long enough
    copies = rows.join(firsts.select("sha", "first"), "sha").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("sha", F.col("doc_id").alias("copy"))
    copies = written(copies, "copies")
    gone = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    match = (source["sha"] == gone["sha"]) & source["doc_id"].eqNullSafe(gone["copy"])
    long = source.filter(F.octet_length("body") >= length).join(gone, match, "left_anti")

    # step 1
    named = long.select("sha", "body").mapInArrow(_named_samples(prefix, parts), _ROW)
    again = written(named.groupBy("part").applyInArrow(_repeated_samples, _ROW), "samples")
    left = written(again.groupBy("chunk").applyInArrow(_by_document(prefix), "sha binary, left binary"), "left")
    remove(spark, again)
    _release(spark)

    # step 2: documents with samples left, in order, in chunks by their running size
    # equal rows of one text were named as two documents
    placed = left.groupBy("sha").agg(F.max("left").alias("left")).join(firsts, "sha")
    placed = with_running(placed.select("sha", "first", "left", "size", F.col("first").isNull().alias("last")), ["last", "first", "sha"], F.col("size"), position="place", before="offset")
    placed = written(placed.select("sha", "first", "left", "place", F.expr(f"offset div {CHUNK}").alias("chunk")), "placed")
    keys = placed.select(F.col("sha").alias("k"), F.col("first").alias("f"), F.col("chunk").alias("c"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    texts = source.join(keys, (source["sha"] == keys["k"]) & source["doc_id"].eqNullSafe(keys["f"])).select(F.col("c").alias("chunk"), "sha", "body")
    chunks = written(texts.groupBy("chunk").cogroup(placed.select(F.col("chunk").alias("of"), "sha", "left", "place").groupBy("of")).applyInArrow(_packed_chunk, "chunk long, data binary"), "chunks", "none")
    _release(spark)
    names = chunks.mapInArrow(_sent_names(length, parts), _ROW)
    bits = written(names.groupBy("part").applyInArrow(_merged, _ROW), "bits")
    _release(spark)
    judged = written(chunks.groupBy("chunk").cogroup(bits.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(_judged(length, parts), _JUDGED), "judged")
    remove(spark, bits, chunks, placed, left)

    full = rows.join(firsts.select("sha", "first"), "sha").join(judged, "sha", "left").withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("first")))
    whole = F.lower(F.hex("sha"))
    one = full.filter("is_first").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", whole).alias("kept_sha256"))
    more = full.withColumn("n", F.col("n") - F.col("is_first").cast("int")).filter("n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    cut = F.col("n_bytes") >= length
    more = more.select("doc_id", "n_bytes", F.when(cut, F.col("n_bytes")).otherwise(0).alias("n_removed"), cut.cast("long").alias("n_spans"), F.when(cut, F.sha2(F.lit("").cast("binary"), 256)).otherwise(whole).alias("kept_sha256"))
    return one.unionByName(more)
