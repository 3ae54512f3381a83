"""Links within clusters of texts that may link, decided on their full shingle sets.

A cluster is compared where it lies, if it fits a block. A larger one is cut into blocks by set size and hash; blocks travel
packed. Within each block all texts are compared, and each text with its best neighbour of the forest. Where that has not
made one component of a cluster yet, the texts outside its main component, in blocks of their own, meet all blocks of the
cluster whose sizes fit. So a group of texts that link costs time in proportion to it, and it is only texts of one cluster
that do not link whose number counts by its square, in blocks: rows are those of blocks and of pairs of blocks.

Two blocks are compared by a product of matrices over the shingles that both have: shared shingles of all pairs at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles as S
from tidemark.llm.common import grouped, packed, unpacked
from tidemark.llm.components import components, joined, spanning
from tidemark.llm.crowded import paired
from tidemark.plans.storage import written

#: Texts and shingles of a block (a text counts as LEAST at least), columns of a matrix, texts that are compared pair by pair.
TEXTS, SHINGLES, LEAST, COLUMNS, FEW = 1024, 1 << 18, 64, 4096, 6


def links(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y that link; sets are not empty."""
    flat = [np.concatenate(s) for s in (x, y)]
    size = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    if x is y:
        values, n = np.unique(flat[0], return_counts=True)
        shared = values[n > 1]
    else:
        shared = np.intersect1d(*flat)
    both = np.zeros((len(x), len(y)), np.float32 if max(map(np.max, size)) < 1 << 24 else np.float64)
    if len(shared):
        at = []
        for f, n in zip(flat, size, strict=True):
            place = np.minimum(np.searchsorted(shared, f), len(shared) - 1)
            hit = shared[place] == f
            at.append((np.repeat(np.arange(len(n)), n)[hit], place[hit]))
        for lo in range(0, len(shared), COLUMNS):
            width = min(COLUMNS, len(shared) - lo)
            sides = []
            for (rows, places), n in zip(at, size, strict=True):
                m = np.zeros((len(n), width), both.dtype)
                here = (places >= lo) & (places < lo + width)
                m[rows[here], places[here] - lo] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
    either = size[0][:, None] + size[1][None, :] - both.astype(np.int64)
    return np.nonzero(100 * both.astype(np.int64) >= percent * either)


def _within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The first text of its component for each of some texts."""
    n = len(sets)
    if n <= FEW:
        pairs = [(i, k) for i in range(n) for k in range(i + 1, n) if S.similar(sets[i], sets[k], percent)]
        return spanning(n, np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    return spanning(n, *links(sets, sets, percent))


def _read(t: pa.Table, width: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Keys and sets of texts (key, text), once for each key."""
    key = t.column("key").to_pylist()
    first = list({k: i for i, k in reversed(list(enumerate(key)))}.values())[::-1]
    return [key[i] for i in first], S.shingle_sets(t.column("text").take(pa.array(first, pa.int64())).to_pylist(), width)


def _pairs(key: list[bytes], root: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(np.bincount(root, minlength=len(key))[root] > 1)
    return pa.RecordBatch.from_arrays([pa.array([key[i] for i in used], pa.binary()), pa.array([key[root[i]] for i in used], pa.binary())], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that link, by their full sets."""
    both = pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y = (S.shingle_sets(part.column(i).to_pylist(), width) for i in (2, 3))
                keep = [i for i in range(part.num_rows) if S.similar(x[i], y[i], percent)]
                yield part.select([0, 1]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def linked(clusters: DataFrame, texts: DataFrame, near: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label) of texts that link with any, from clusters (key, label, n_shingles), texts (key, text), and near (a, b, agree), a
    likely partner b of each text a."""
    by = lambda k: F.sum(F.greatest("n_shingles", F.lit(LEAST))).alias(k)
    large = clusters.groupBy("label").agg(by("s"), F.count(F.lit(1)).alias("n")).filter((F.col("s") > SHINGLES) | (F.col("n") > TEXTS)).select("label")
    large = written(large, "large")
    few = large.isEmpty()
    rows = clusters.select("key", "label") if few else clusters.select("key", "label").join(large, "label", "left_anti")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            key, sets = _read(t, width)
            yield _pairs(key, _within(sets, percent))

    at_once = rows.join(texts, "key").select(F.xxhash64("label").alias("group"), "key", "text").repartition("group").sortWithinPartitions("group")
    out = written(at_once.mapInArrow(small, "a binary, b binary").select(F.col("a").alias("node"), F.col("b").alias("label")), "linked")
    return out if few else out.unionByName(_large(clusters.join(large, "label", "left_semi"), texts, near, width, percent))


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds size_class, part and block to (key, cluster, n_shingles): only texts of the same or neighbouring size classes can link."""
    rows = rows.withColumn("size_class", F.floor(F.log(F.col("n_shingles")) / math.log(1.25)).cast("int"))
    n = rows.groupBy("cluster", "size_class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TEXTS), F.ceil(F.sum(F.greatest("n_shingles", F.lit(LEAST))) / SHINGLES)).alias("parts"))
    rows = rows.join(n, ["cluster", "size_class"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    return rows.withColumn("block", F.xxhash64("cluster", "size_class", "part")).drop("parts")


def _large(clusters: DataFrame, texts: DataFrame, near: DataFrame, width: int, percent: int) -> DataFrame:
    members = written(clusters.select("key", F.xxhash64("label").alias("cluster"), "n_shingles"), "members")
    dealt = written(_blocks(members), "dealt")
    blobs = lambda d: written(packed(d.join(texts, "key"), "block", ["key", "text"], "zstd"), "blocks")
    full = blobs(dealt)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                key, sets = _read(unpacked(data.as_py()), width)
                yield _pairs(key, _within(sets, percent))

    # the best partner of each text, once for a pair
    best = near.join(members.select(F.col("key").alias("a")), "a", "left_semi").groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = full.select("data").mapInArrow(within, "a binary, b binary").unionByName(confirmed(best, texts, width, percent))
    labels = components(written(first, "first"))
    now = dealt.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    now = written(now, "now")
    main = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = written(now.join(main, "cluster").filter("label <> main").select("key", "cluster", "n_shingles"), "rest")
    if rest.isEmpty():
        return labels
    apart = written(_blocks(rest), "apart")
    own = apart.withColumn("block", F.xxhash64("block", F.lit("rest")))
    ends = lambda d, c: d.select("cluster", F.col("size_class").alias(f"s{c}"), F.col("block").alias(c)).distinct()
    pairs = ends(own, "x").join(ends(dealt, "y"), "cluster").filter("abs(sx - sy) <= 1").select("x", "y")

    def compare(x: pa.Table, y: pa.Table) -> pa.RecordBatch:
        (kx, sx), (ky, sy) = _read(x, width), _read(y, width)
        i, k = links(sx, sy, percent)
        root = spanning(len(kx) + len(ky), i, k + len(kx))
        return _pairs(kx + ky, root)

    more = paired(pairs, full.unionByName(blobs(own)), compare).filter("a <> b")
    return joined(labels, written(more.distinct(), "more"))
