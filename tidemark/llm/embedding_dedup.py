"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative for each group.

Equal vectors become one class first, so a vector that a third of all rows share is one row of the products. Each class goes
to its nearest cell, and is compared with its own cell and with those cells that can hold a partner. That test is exact:
if x lies in cell i and y in cell j, then y is not nearer to i's centre, so x is at most |x - y| beyond the plane midway
between the centres; for a cosine of at least t, |x - y| is at most sqrt(2 - 2t). No pair is lost; where the data have no
clusters the test spares little, and all blocks meet.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows without vec_id. Only
vectors of one length can link; each length has its own cells, the V.MODELS commonest lengths by k-means, the others one
each. Rows that repeat a vec_id count as one vector each in n_links' classes. Ties do not matter. An empty table gives an empty one.
Other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import packed, unpacked
from tidemark.llm.components import components, spanning
from tidemark.plans.storage import scoped, written

THRESHOLD = 0.9
#: Classes that a cell has about, most cells, rounds of k-means.
CELL_ROWS, MOST_CELLS, ROUNDS = 4096, 1024, 12


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centres; an empty cell starts again at the vector that its own centre fits least."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        sims = x @ centres.T
        home = sims.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        for c in np.flatnonzero(~np.bincount(home, minlength=len(centres)).astype(bool)):
            sums[c] = x[sims.max(1).argmin()]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def reachable(x: np.ndarray, centres: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector and cell: whether a vector of the cell can have a cosine of at least threshold with it."""
    sims = x @ centres.T
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    ahead = sims[np.arange(len(x)), home][:, None] - sims
    return ahead <= math.sqrt(2 - 2 * threshold) * gaps[home] + 1e-9


def _links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that link, by strips of rows; of equal blocks each pair once."""
    left, right = [], []
    for at in range(0, len(a), 512):
        g = a[at : at + 512] @ b.T >= threshold
        if same:
            g &= np.arange(len(b))[None, :] > np.arange(at, at + len(g))[:, None]
        i, j = np.nonzero(g)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def link_classes(classes: DataFrame, threshold: float = THRESHOLD, block: int = V.BLOCK, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS) -> DataFrame:
    """From classes (key, n_dim, vec, n): (key, links, other), where links sums to the linked vectors of other classes, and the pairs key, other span the components."""
    spark = classes.sparkSession
    schema = "key binary, links long, other binary"
    # cells of one length are numbered from its offset
    models: dict[int, tuple[int, np.ndarray | None]] = {}
    offset = 0
    for i, (dim, n) in enumerate(V.lengths(classes).items()):
        k = min(most_cells, n // cell_rows) if i < V.MODELS else 0
        x = V.fit_sample(classes, dim, n) if k > 1 else None
        models[dim] = offset, None if x is None else spherical_kmeans(x, min(k, len(x)))
        offset += 1 if x is None else len(models[dim][1])
    if not models:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(models)

    def assign(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, at, x in V.by_length(batch):
                first, centres = shared.value[dim]
                cell[at] = first if centres is None else first + (V.units(x) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["key", "n_dim", "vec", "n", "cell"])

    homed = written(classes.select("key", "n_dim", "vec", "n").mapInArrow(assign, "key binary, n_dim int, vec binary, n long, cell int"), "homed")
    cells = V.blocks_of({r["cell"]: r["count"] for r in homed.groupBy("cell").count().collect()}, block)
    homed = V.dealt(homed, cells)

    def reach(batches):
        for batch in batches:
            pairs: set[tuple[int, int]] = set()
            cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            for dim, at, x in V.by_length(batch):
                first, centres = shared.value[dim]
                if centres is None:
                    continue
                can = reachable(V.units(x), centres, cell[at] - first, threshold)
                pairs |= {(int(b), first + int(j)) for b in np.unique(block[at]) for j in np.flatnonzero(can[block[at] == b].any(0)) if first + int(j) in cells}
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in sorted(pairs)], pa.int32()) for c in (0, 1)], names=["b1", "cell"])

    met = homed.select("n_dim", "vec", "cell", "block").mapInArrow(reach, "b1 int, cell int").distinct()
    firsts = spark.createDataFrame([(c, a, k) for c, (a, k) in cells.items()], "cell int, first int, k int")
    own = homed.select(F.col("block").alias("b1"), "cell").distinct()
    met = met.unionByName(own).distinct().join(F.broadcast(firsts), "cell").select("b1", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("b2"))
    # both directions pass the test if any pair links, so one is enough
    pairs = written(met.filter("b1 <= b2").withColumn("pair", F.xxhash64("b1", "b2")), "blockpairs")
    blobs = written(packed(homed, "block", ["key", "vec", "n"]), "blocks")
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    sides = sides.join(blobs, "block")

    def compare(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("block").to_numpy())
        tables = [unpacked(group.column("data")[int(o)].as_py()) for o in order]
        same = len(tables) == 1
        keys = [t.column("key").to_pylist() for t in tables]
        xs = [V.units(V.matrix(t.column("vec").to_pylist())) for t in tables]
        ns = [t.column("n").to_numpy() for t in tables]
        i, j = _links(xs[0], xs[-1], threshold, same)
        shift = 0 if same else len(keys[0])
        names, weight = keys[0] + ([] if same else keys[1]), ns[0] if same else np.concatenate(ns)
        j = j + shift
        links = np.bincount(i, weight[j], len(names)) + np.bincount(j, weight[i], len(names))
        root = spanning(len(names), i, j)
        used = np.flatnonzero(links)
        return pa.table({"key": pa.array([names[u] for u in used], pa.binary()), "links": pa.array(links[used].astype(np.int64)), "other": pa.array([names[root[u]] for u in used], pa.binary())})

    return written(sides.groupBy("pair").applyInArrow(compare, schema), "links")


@scoped
def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of df."""
    rows = written(V.prepared(df, vec_id, embedding).drop("asked"), "vectors")
    takes = F.col("vec_id").isNotNull() & F.col("key").isNotNull()
    classes = written(rows.filter(takes).groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("n_dim").alias("n_dim"), F.max("vec").alias("vec")), "classes")
    links = link_classes(classes, threshold, **kw)
    labels = components(links.select(F.col("key").alias("a"), F.col("other").alias("b")))
    per = classes.select("key", "first", "n").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
    per = written(per.select("key", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "key").alias("label")), "perclass")
    least = written(per.groupBy("label").agg(F.min("first").alias("component")), "least")
    per = written(per.join(least, "label").select("key", "component", (F.col("links") + F.col("n") - 1).alias("n_links")), "perclass")
    marked = rows.select("vec_id", F.when(takes, F.col("key")).alias("key"))
    out = marked.join(per, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
