"""Near-duplicate texts by an LSH forest: several sorted orders of signatures, in which longest common prefixes give candidates.

Each tree sorts all signatures by its own slice of minhash values. Similar texts share a long prefix there and so come to
lie side by side. How deep a prefix must be shared depends on the region: a text's region in a tree is the run of texts that
share as many leading values with it as it takes for the run to have no more than WINDOW texts; where even all DEPTH values
are shared by more, neighbours within WINDOW stand for the region. All texts of a region are candidates for one another, of
which those must agree in signature so well that a true link is missed with a chance of about one in a million. No region
is gathered: the orders are dealt out by ranges of whole records, so that a region of any size is cut across tasks, and the
few records at the cuts are compared once more, in ever fewer ranges.

Texts with equal shingle sets become one class first. What comes out of a region are not pairs but, for each text, a member
that stands for its likely partners there. Texts joined in this way are a cluster. Which of them link is decided on their full sets, by the module
confirm. Texts for which the depths of their regions leave too much chance of missing a link are looked at
again, by the module crowded: no link is lost to a window.

Null and empty texts, and those without words, have no shingles and link with nothing. Rows with a null doc_id link like
others but name no component. Rows that repeat a doc_id count with their own text each. Ties in signature or size change
nothing. An empty table gives an empty one. Other columns are not read; near_duplicates() does not return them, and
deduplicated() returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from tidemark.llm import confirm, crowded
from tidemark.llm import shingles as S
from tidemark.llm.common import binaries, fresh, spark_parts
from tidemark.llm.components import components, joined, spanning
from tidemark.plans.storage import scoped, written

#: Trees, minhash values of each, texts of a region, signature bytes that records carry.
TREES, DEPTH, WINDOW, SHORT = 12, 8, 48, 64
#: Ranges whose cuts meet in one range of the next level.
CUTS = 64
#: Standard deviations that an estimate may lie below the threshold.
SIGMAS = 4.75
#: Rows of a table of keys that is broadcast, at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(77)
_A = _RNG.integers(1, 2**63, TREES * DEPTH, np.int64).astype(S.U) * S.U(2) + S.U(1)
_B = _RNG.integers(1, 2**63, TREES * DEPTH, np.int64).astype(S.U)
#: A record: tree, its values, key, set size, one byte of each of the first values of the signature.
_KEY_AT = 1 + 4 * DEPTH
_SIZE_AT = _KEY_AT + 16
_SIG_AT = _SIZE_AT + 8
_LENGTH = _SIG_AT + SHORT


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    low = np.full(len(_A), 2**64 - 1, S.U)
    for at in range(0, len(s), 1024):
        np.minimum(low, (s[at : at + 1024, None] * _A[None, :] + _B[None, :]).min(0), out=low)
    return (S.mix(low) >> S.U(32)).astype(">u4")


def signed(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, key, sig) of each row; key and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = S.shingle_sets(batch.column(1).to_pylist(), width)
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([S.set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_shingles long, key binary, sig binary")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, n_shingles, sig), a record for each tree."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, TREES * DEPTH, 4)
        out = np.zeros((n, TREES, _LENGTH), np.uint8)
        out[:, :, 0] = np.arange(TREES)
        out[:, :, 1:_KEY_AT] = sig.reshape(n, TREES, 4 * DEPTH)
        out[:, :, _KEY_AT:_SIZE_AT] = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, 1, 16)
        out[:, :, _SIZE_AT:_SIG_AT] = batch.column(1).to_numpy().astype(">u8").view(np.uint8).reshape(n, 1, 8)
        out[:, :, _SIG_AT:] = sig[:, None, :SHORT, 3]
        yield pa.RecordBatch.from_arrays([binaries(out.reshape(-1, _LENGTH))], names=["rec"])


_FOUND = "a binary, b binary, best binary, agree int, depth int, region long, rec binary"
_KINDS = (("a", pa.binary()), ("b", pa.binary()), ("best", pa.binary()), ("agree", pa.int32()), ("depth", pa.int32()), ("region", pa.int64()), ("rec", pa.binary()))


def _found(n: int, **cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[k] if k in cols else pa.nulls(n, kind) for k, kind in _KINDS], names=[k for k, _ in _KINDS])


def regions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some records in order, how deep its region is, DEPTH + 1 if that is not deep enough, and where the region starts."""
    n = len(rows)
    shared = (rows[1:, :_KEY_AT] == rows[:-1, :_KEY_AT])
    equal = shared[:, 1:].reshape(n - 1, DEPTH, 4).all(2) & shared[:, :1]
    prefix = np.logical_and.accumulate(equal, axis=1).sum(1)
    depth, start = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for d in range(1, DEPTH + 1):
        first = np.r_[True, prefix < d]
        run = np.cumsum(first) - 1
        fits = (depth == 0) & (np.bincount(run)[run] <= WINDOW)
        if d == DEPTH:
            depth[(depth == 0) & ~fits] = DEPTH + 1
            fits = fits | (depth == DEPTH + 1)
        depth[fits & (depth == 0)] = d
        start[fits] = np.flatnonzero(first)[run[fits]]
    return depth, start


def _scan(percent: int, cuts: bool):
    """Likely partners and depths of the records of a range, in order; with cuts, also the records at either end of it."""
    j = percent / 100
    least = max(1, int(np.floor(SHORT * (j - SIGMAS * np.sqrt(j * (1 - j) / SHORT)))))

    def look(rows: np.ndarray, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        if not n:
            return
        depth, start = regions(rows)
        size = rows[:, _SIZE_AT:_SIG_AT].copy().view(">u8").ravel().astype(np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(1, min(WINDOW, n - 1) + 1):
            at = np.flatnonzero(start[: n - step] == start[step:])
            if not len(at):
                break
            small, large = np.minimum(size[at], size[at + step]), np.maximum(size[at], size[at + step])
            at = at[100 * small >= percent * large]
            agree = (rows[at, _SIG_AT:] == rows[at + step, _SIG_AT:]).sum(1)
            ok = agree >= least
            pairs.append((at[ok], at[ok] + step, agree[ok]))
        i, k, agree = (np.concatenate([p[c] for p in pairs] or [np.zeros(0, np.int64)]) for c in range(3))
        keys = rows[:, _KEY_AT:_SIZE_AT]
        if len(i):
            root = spanning(n, i, k)
            owner, other, agree = np.r_[i, k], np.r_[k, i], np.r_[agree, agree]
            order = np.lexsort((agree, owner))
            last = order[np.r_[owner[order][1:] != owner[order][:-1], True]]
            own = owner[last]
            yield _found(len(own), a=binaries(keys[own]), b=binaries(keys[root[own]]), best=binaries(keys[other[last]]), agree=pa.array(agree[last].astype(np.int32)))
        deep = lo + np.flatnonzero(depth[lo:hi] > 1)
        if len(deep):
            two = rows[deep, 1:9].copy().view(">u8").ravel().astype(np.uint64)
            region = S.mix(two * S.U(TREES) + rows[deep, 0].astype(np.uint64))
            yield _found(len(deep), a=binaries(keys[deep]), depth=pa.array(depth[deep]), region=pa.array(region.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, head = np.zeros((0, _LENGTH), np.uint8), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, _LENGTH)
            if cuts and head < WINDOW:
                first = new[: WINDOW - head]
                yield _found(len(first), rec=binaries(first))
                head += len(new)
            held = np.concatenate([held, new])
            if len(held) > 2 * WINDOW + 4096:
                yield from look(held, done, len(held) - WINDOW)
                held, done = held[-2 * WINDOW :], WINDOW
        yield from look(held, done, len(held))
        if cuts and len(held):
            yield _found(len(held[-WINDOW:]), rec=binaries(held[-WINDOW:]))

    return run


def forest(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of classes (key, n_shingles, sig): (a, b), which join a text to what stands for its likely partners; (a, b, agree), a likely partner
    that agrees best in a tree; and (key, depth, region) for each tree that had to go beyond one value."""
    records, parts = classes.select("key", "n_shingles", "sig").mapInArrow(_records, "rec binary"), max(2, spark_parts(classes))
    levels: list[DataFrame] = []
    while parts:
        ordered = (records.repartitionByRange(parts, "rec") if parts > 1 else records.coalesce(1)).sortWithinPartitions("rec")
        levels.append(written(ordered.mapInArrow(_scan(percent, parts > 1), _FOUND), "forest"))
        records = levels[-1].filter("rec is not null").select("rec").distinct()
        parts = 0 if parts == 1 else -(-parts // CUTS)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    joins = written(found.filter("b is not null").groupBy("a", "b").agg(F.max(F.struct("agree", "best")).alias("m")).select("a", "b", "m.*"), "joins")
    deep = found.filter("depth is not null").select(F.col("a").alias("key"), "depth", "region")
    return joins.filter("a <> b").select("a", "b"), joins.select("a", F.col("best").alias("b"), "agree"), deep


def _texts(docs: DataFrame, wanted: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(key, text), once for each key of wanted (doc_id, key). Classes without a doc_id find their texts by key, in rows without one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    unnamed = wanted.filter("doc_id is null").select("key")
    unnamed_rows = unnamed.count()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    named = rows.join(wanted, "doc_id").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = S.shingle_sets(batch.column(1).to_pylist(), width)
            same = [len(s) > 0 and S.set_key(s) == k for s, k in zip(sets, batch.column(0).to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    found = named.mapInArrow(run, "key binary, text string")
    if unnamed_rows:
        keyed = _keyed(rows.filter("doc_id is null").select("text"), width, "text", "key").select("key", "text")
        found = found.unionByName(keyed.join(F.broadcast(unnamed) if unnamed_rows <= BROADCAST_ROWS else unnamed, "key").dropDuplicates(["key"]))
    return written(found, "texts")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; component_id is the smallest doc_id that links lead to."""
    return judged(docs, width, percent, text, doc_id).drop("key")


@scoped
def judged(docs: DataFrame, width: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """near_duplicates, with the key of each row's class."""
    rows = written(signed(docs, width, text, doc_id), "signed")
    full = rows.filter("key is not null")
    classes = written(full.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")), "classes")
    joins, near, deep = forest(classes, percent)
    clusters = components(joins)
    unsure = crowded.open_texts(deep, clusters, percent, TREES, DEPTH)
    unsure = unsure.join(classes, "key").join(clusters.withColumnRenamed("node", "key"), "key", "left")
    unsure = written(unsure.select("key", F.coalesce("label", "key").alias("label"), "n_shingles", "sig"), "unsure")
    clusters = joined(clusters, crowded.meetings(unsure, percent, SIGMAS))
    members = classes.select("key", "first", "n_shingles").join(clusters.withColumnRenamed("node", "key"), "key")
    members = written(members, "members")
    texts = _texts(docs, members.select(F.col("first").alias("doc_id"), "key"), width, text, doc_id)
    labels = confirm.linked(members.select("key", "label", "n_shingles"), texts, near, width, percent)
    per = classes.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("label", "key").alias("label"))
    per = written(per, "perclass")
    least = written(per.groupBy("label").agg(F.min("first").alias("component")), "least")
    per = written(per.join(least, "label").select("key", "component"), "perclass")
    out = rows.select("doc_id", "n_shingles", "key").join(per, "key", "left").select("doc_id", "n_shingles", "key", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each component; of rows that are equal in doc_id and text one stays. Rows without doc_id cannot be told apart and stay.

    What goes is joined out by broadcast up to BROADCAST_ROWS ids, so that the texts stay where they are. Where a doc_id has
    rows that stay and rows that go, the key of their texts tells them apart.
    """
    known, of_set = fresh(docs.columns, "_id", "_set")
    rows = judged(docs, width, percent, text, doc_id).filter("doc_id is not null")
    rows = rows.select(F.col("doc_id").alias(known), F.col("key").alias(of_set), "kept")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    ids = written(rows.groupBy(known).agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go")).filter("stay > 1 or go > 0"), "ids")
    gone, again, mixed = (ids.filter(c).select(known) for c in ("go > 0", "stay > 1", "stay > 0 and go > 0"))
    named = F.col(doc_id) == F.col(known)
    kept = docs.join(small(gone), named, "left_anti")
    if not mixed.isEmpty():
        own = fresh([*docs.columns, of_set], "_key")[0]
        part = _keyed(docs.join(small(mixed), named, "left_semi"), width, text, own)
        out = rows.filter("not kept").join(small(mixed), known, "left_semi").select(known, of_set).distinct()
        part = part.join(out, named & (F.col(own) == F.col(of_set)), "left_anti")
        kept = kept.unionByName(part.drop(own))
    once = kept.join(small(again), named, "left_anti")
    return once.unionByName(kept.join(small(again), named, "left_semi").dropDuplicates([doc_id, text]))


def _keyed(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """Adds the key of each row's set; null for an empty one."""
    at, names = docs.columns.index(text), [*docs.columns, key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = S.shingle_sets(batch.column(at).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([S.set_key(s) if len(s) else None for s in sets], pa.binary())], names=names)

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(key, BinaryType()))
