"""Regions that a forest could not look through: which texts may lie in one cluster with others there.

A tree that had to go d values deep to find a small region misses a link of similarity s with a chance of 1 - s ** d. A text
for which all trees together leave more than MISS is open, unless the wider regions around it hold one cluster only. Open
texts are brought together once more, in BANDS buckets of DEPTH values, where a link of similarity 0.8 is missed with a
chance of three in a million. In a bucket a cluster grows from text to text: those reached are left out from then on, so
that a bucket of texts that resemble one another takes about one comparison a text. A bucket is cut into parts of PART
texts, which travel packed; rows are those of parts and pairs of parts. Out come one pair for each two clusters that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grouped, packed, unpacked
from tidemark.plans.storage import written

#: The greatest chance of missing a link that trees may leave; values of a bucket, buckets of a text, texts of a part.
MISS, DEPTH, BANDS, PART = 5e-6, 4, 24, 2048
#: Rows of a table of regions that is broadcast, at most.
BROADCAST_ROWS = 500_000


def open_texts(deep: DataFrame, labels: DataFrame, percent: int, trees: int, depth: int) -> DataFrame:
    """(key) of open texts, from deep (key, depth, region): trees that had to go beyond one value for a text, and the region
    of two values there. labels (node, label) are clusters so far."""
    j = min(percent, 99) / 100
    chance = lambda d: F.when(d > depth, F.lit(0.0)).otherwise(F.log(1 - F.pow(F.lit(j), d)))
    rest = (F.lit(trees) - F.count(F.lit(1))) * float(np.log(1 - j))
    left = lambda df: df.groupBy("key").agg((F.sum(chance(F.col("d"))) + rest).alias("miss")).filter(F.col("miss") > float(np.log(MISS)))
    deep = written(deep.groupBy("key", "region").agg(F.max("depth").alias("d")), "deep")
    unsure = left(deep).select("key")
    # a region of any size is summed up where its rows are; its rows are not brought together
    there = deep.filter("d > 2").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    closed = there.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo = hi").select("region", F.lit(2).alias("two"))
    closed = written(closed, "closed")
    closed = F.broadcast(closed) if closed.count() <= BROADCAST_ROWS else closed
    mine = deep.join(unsure, "key", "left_semi").join(closed, "region", "left").select("key", F.least("d", F.coalesce("two", "d")).alias("d"))
    return written(left(mine).select("key"), "open")


def reach(label: np.ndarray, sig: np.ndarray, size: np.ndarray, percent: int, least: int) -> list[tuple[int, int]]:
    """Pairs of rows that may link and together join all labels that can be joined."""
    rest = np.arange(len(label))
    out: list[tuple[int, int]] = []
    while len(rest):
        new = rest[label[rest] == label[rest[0]]]
        rest = rest[label[rest] != label[rest[0]]]
        queue = [new]
        while queue and len(rest):
            batch = queue.pop()
            for at in range(0, len(batch), 32):
                few = batch[at : at + 32]
                if not len(rest):
                    break
                fits = 100 * np.minimum(size[few][:, None], size[rest]) >= percent * np.maximum(size[few][:, None], size[rest])
                fits &= (sig[few][:, None, :] == sig[rest][None, :, :]).sum(2) >= least
                hit = np.flatnonzero(fits.any(0))
                if len(hit):
                    names, first = np.unique(label[rest[hit]], return_index=True)
                    out += [(int(few[fits[:, hit[f]].argmax()]), int(rest[hit[f]])) for f in first]
                    found = np.isin(label[rest], names)
                    queue.append(rest[found])
                    rest = rest[~found]
    return out


def _reached(tables: list[pa.Table], percent: int, least: int) -> pa.RecordBatch:
    column = lambda c: [v for t in tables for v in t.column(c).to_pylist()]
    key, sig = column("key"), np.frombuffer(b"".join(column("sig")), np.uint8).reshape(-1, DEPTH * BANDS)
    label = np.unique(np.array(column("label"), object), return_inverse=True)[1]
    pairs = reach(label, sig, np.array(column("n_shingles")), percent, least)
    return pa.RecordBatch.from_arrays([pa.array([key[p[c]] for p in pairs], pa.binary()) for c in (0, 1)], names=["a", "b"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each value of the signature."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, DEPTH * BANDS, 4)[:, :, 3]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in sig], pa.binary())], names=["key", "label", "n_shingles", "sig"])


def meetings(texts: DataFrame, percent: int, sigmas: float) -> DataFrame:
    """(a, b): of texts (key, label, n_shingles, sig), pairs that may link and join all labels that can be joined in a bucket."""
    j, n = percent / 100, DEPTH * BANDS
    least = max(1, int(np.floor(n * (j - sigmas * np.sqrt(j * (1 - j) / n)))))
    values = [F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * DEPTH * i, 4 * DEPTH)) for i in range(BANDS)]
    members = written(texts.select("key", "label", F.explode(F.array(*values)).alias("bucket")), "buckets")
    counts = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    mixed = written(counts.filter("lo <> hi").select("bucket", F.ceil(F.col("n") / PART).alias("parts")), "mixed")
    short = written(texts.mapInArrow(_short, texts.schema), "short")
    rows = members.select("key", "bucket").join(mixed, "bucket").join(short, "key")
    columns = ["key", "label", "n_shingles", "sig"]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            yield _reached([t], percent, least)

    whole = rows.filter("parts = 1").select("bucket", *columns).repartition("bucket").sortWithinPartitions("bucket")
    found = whole.mapInArrow(small, "a binary, b binary")
    if not mixed.filter("parts > 1").isEmpty():
        cut = rows.filter("parts > 1").select(F.xxhash64("bucket", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("block"), *columns)
        blobs = written(packed(cut, "block", columns), "parts")
        i, k = (F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(c) for c in "ik")
        pairs = mixed.filter("parts > 1").select("bucket", "parts", i).select("bucket", "i", k).filter("i <= k")
        found = found.unionByName(paired(pairs.select(F.xxhash64("bucket", "i").alias("x"), F.xxhash64("bucket", "k").alias("y")), blobs, lambda x, y: _reached([x] if y is None else [x, y], percent, least)))
    return written(found.distinct(), "meetings")


def paired(pairs: DataFrame, blobs: DataFrame, compare, schema: str = "a binary, b binary") -> DataFrame:
    """compare(x, y) for each of pairs (x, y) of blocks of blobs (block, data); y is None where they are the same block."""
    pairs = pairs.withColumn("pair", F.xxhash64("x", "y"))
    sides = pairs.select("pair", F.col("x").alias("block"), F.lit(0).alias("side")).unionByName(pairs.filter("x <> y").select("pair", F.col("y").alias("block"), F.lit(1).alias("side")))

    def run(group: pa.Table) -> pa.Table:
        blocks = dict(zip(group.column("side").to_pylist(), group.column("data"), strict=True))
        return pa.Table.from_batches([compare(*(unpacked(blocks[s].as_py()) if s in blocks else None for s in (0, 1)))])

    return sides.join(blobs, "block").select("pair", "side", "data").groupBy("pair").applyInArrow(run, schema)
