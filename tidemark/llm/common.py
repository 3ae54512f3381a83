"""Small things that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Word starts are counted, without making an array of words."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.regexp_count(flat, F.lit("[^ ]++")).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys only; null counts as a key."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def spark_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """names, each with underscores put before it until no column in taken, upper or lower case, has it."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return tuple(out)


def binaries(rows: np.ndarray) -> pa.BinaryArray:
    """A row of bytes for each row of a two-dimensional array."""
    n, width = rows.shape
    offsets = (np.arange(n + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def packed(rows: DataFrame, by: str, columns: Sequence[str], codec: str | None = None) -> DataFrame:
    """One row for each value of by, with the bytes of an Arrow file of the columns as data."""
    kind = rows.schema[by].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        part = table.select(list(columns)).combine_chunks()
        with pa.ipc.new_file(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
            w.write_table(part)
        return pa.table({by: pa.array([key[0].as_py()], key[0].type), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.select(by, *columns).groupBy(by).applyInArrow(run, f"{by} {kind}, data binary")


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_file(pa.BufferReader(data)).read_all()


def grouped(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.Table]:
    """Runs of rows that share the first column, a number, from batches sorted by it; no more than `rows` rows are looked at in one step."""
    held: list[pa.RecordBatch] = []
    last = None
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            ids = batch.column(0).to_numpy()
            at = 0
            for cut in [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]:
                if held and ids[at] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(at, cut - at))
                last, at = ids[at], cut
    if held:
        yield pa.Table.from_batches(held)
