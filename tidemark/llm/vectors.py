"""What the two operators on vectors share: which rows take part, classes of equal vectors, blocks of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, about; two blocks are what one task holds.
BLOCK = 8192
#: Different vectors of one length that models are fitted on, at most; lengths that have models, the commonest.
SAMPLE, MODELS = 8192, 4


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their length, in double precision, scaled first so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 1))


def prepared(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", asked: Column | None = None) -> DataFrame:
    """(vec_id, asked, n_dim, key, vec): vec holds the doubles of a valid vector and key, of 16 bytes, names its value; both
    are null for a vector that is null, empty, zero, or holds null or non-finite components. Runs in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            ends = np.cumsum(length)
            count = lambda hit: np.r_[0, np.cumsum(hit)][ends] - np.r_[0, np.cumsum(hit)][ends - length]
            good = (length > 0) & (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)
            raw = flat.tobytes()
            vecs = [raw[8 * (e - n) : 8 * e] if ok else None for e, n, ok in zip(ends, length, good, strict=True)]
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            dims = np.where(good, length, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "asked", "n_dim", "key", "vec"])

    wanted = F.lit(False) if asked is None else F.coalesce(asked, F.lit(False))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), wanted.alias("asked"), F.col(embedding).alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, asked boolean, n_dim int, key binary, vec binary")


def by_length(batch: pa.RecordBatch, dims: str = "n_dim", vec: str = "vec") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector in a batch: the length, the rows that have it, and their matrix."""
    n, blobs = batch.column(dims).to_numpy(), batch.column(vec)
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield int(d), at, matrix(blobs.take(pa.array(at)).to_pylist())


def lengths(rows: DataFrame) -> dict[int, int]:
    """Number of different vectors of each length (estimated, the same in each run), the commonest length first. What comes to the driver is a row for each length."""
    got = rows.groupBy("n_dim").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()
    return {r["n_dim"]: r["n"] for r in sorted(got, key=lambda r: (-r["n"], r["n_dim"]))}


def fit_sample(rows: DataFrame, dim: int, n: int, most: int = SAMPLE) -> np.ndarray:
    """Unit vectors of length dim, at most `most` different ones of about n, chosen by hash of their values: copies of one vector
    count once, and reruns choose the same."""
    h, bits = F.xxhash64("key", F.lit(3)), 1 << 30
    share = min(1.0, 1.25 * most / max(1, n))
    some = rows.filter((F.col("n_dim") == dim) & (F.pmod(h, F.lit(bits)) < int(share * bits)))
    got = some.groupBy("key").agg(F.first("vec").alias("vec")).orderBy(F.pmod(h, F.lit(bits)), "key").limit(most).collect()
    got.sort(key=lambda r: bytes(r["key"]))
    return units(matrix([bytes(r["vec"]) for r in got])) if got else np.zeros((0, 1))


def blocks_of(counts: dict[int, int], block: int = BLOCK) -> dict[int, tuple[int, int]]:
    """cell: (first block, number of blocks), so that blocks have about `block` rows."""
    out, at = {}, 0
    for cell in sorted(counts):
        n = max(1, -(-counts[cell] // block))
        out[cell] = (at, n)
        at += n
    return out


def dealt(rows: DataFrame, blocks: dict[int, tuple[int, int]], cell: str = "cell", out: str = "block") -> DataFrame:
    """Deals the rows of a cell out to its blocks by hash; what goes along is a row for each cell."""
    table = rows.sparkSession.createDataFrame([(c, a, n) for c, (a, n) in blocks.items()], f"`_cell` int, _first int, _n int")
    joined = rows.join(F.broadcast(table), rows[cell] == F.col("_cell"))
    return joined.withColumn(out, F.col("_first") + F.pmod(F.xxhash64("key"), F.col("_n")).cast("int")).drop("_cell", "_first", "_n")
