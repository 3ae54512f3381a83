"""Approximate nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, and a small classifier learns which parts a vector's
neighbours lie in. Every row goes to its most probable part; a query looks at its several most probable parts and ranks
what it finds by exact cosines. How many parts are looked at is set on sampled vectors that the classifier has not seen, so
that they find at least `recall` of their neighbours.

Rows that are null, empty, zero, hold null or non-finite components or have no vec_id take no part. Vectors are compared with those
of their own length; the V.MODELS commonest lengths have learned partitions, each other length is one part. Copies of one vector
count once in what is learned. Equal vectors tie, and ties go to the smaller vec_id. Fewer candidates than k give fewer rows,
an empty table none. Queries may be chosen by any column of df; no column but these two is returned, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import packed, unpacked
from tidemark.plans.storage import scoped, written

#: Rows a part has about, fewest and most parts, neighbours in the graph, hidden units, passes, recall aimed at.
PART_ROWS, FEWEST, MOST, NEIGHBOURS, HIDDEN, PASSES, RECALL = 4096, 4, 256, 10, 128, 40, 0.96
#: Rows and queries of a block: what one task compares.
BLOCK, QUERIES = 8192, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        g = (x[at : at + 512] @ x.T).astype(np.float32)
        g[np.arange(len(g)), np.arange(at, at + len(g))] = -2
        out[at : at + 512] = np.argpartition(-g, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_parts(near: np.ndarray, x: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Parts of about equal size that cut few edges: a split by halves along the widest direction, then moves to the part where most neighbours are."""
    part = np.zeros(len(x), np.int64)
    groups, rng = [np.arange(len(x))], np.random.default_rng(seed)
    while len(groups) < parts:
        groups.sort(key=len)
        g = groups.pop()
        v = rng.standard_normal(x.shape[1])
        centred = x[g] - x[g].mean(0)
        for _ in range(10):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) or 1.0
        order = g[np.argsort(centred @ v, kind="stable")]
        groups += [order[: len(g) // 2], order[len(g) // 2 :]]
    for i, g in enumerate(groups):
        part[g] = i
    room = slack * len(x) / parts
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[near[i]], minlength=parts).astype(float)
            votes[sizes >= room] = -1
            votes[part[i]] += 0.5 if sizes[part[i]] < room else 1.5
            to = int(votes.argmax())
            if to != part[i]:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer that gives each part's probability."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, passes: int = PASSES, seed: int = 9):
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], target.shape[1]
        w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d) * np.sqrt(d) / 4, np.zeros(hidden), rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
        m, s, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(passes):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(0, x[at] @ w[0] + w[1])
                z = h @ w[2] + w[3]
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                dz = (q - target[at]) / len(at)
                dh = (dz @ w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    w[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]


def fit(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router | None, int]:
    """A router fitted on half of the sample, and how many parts to look at by what the other half finds of itself."""
    if parts < 2 or len(x) < 4 * parts:
        return None, 1
    order = np.random.default_rng(1).permutation(len(x))
    train, other = x[order[: len(x) // 2]], x[order[len(x) // 2 :]]
    near = neighbour_graph(train, NEIGHBOURS)
    part = balanced_parts(near, train, parts)
    target = np.zeros((len(train), parts))
    np.add.at(target, (np.arange(len(train)), part), 1)
    for c in range(near.shape[1]):
        np.add.at(target, (np.arange(len(train)), part[near[:, c]]), 1)
    router = Router(train, target / target.sum(1, keepdims=True))
    scores = router.scores(other)
    home, true = scores.argmax(1), neighbour_graph(other, k)
    place = np.argsort(np.argsort(-scores, axis=1), axis=1)
    needed = place[np.arange(len(other))[:, None], home[true]].ravel()
    found = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    return router, int(np.searchsorted(found, recall) + 1) if found[-1] >= recall else parts


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows of q with rows of x, each computed alone, so that equal vectors get equal values."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


@scoped
def search(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of df for which queries holds, itself left out."""
    spark = df.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = V.prepared(df, vec_id, embedding, queries).filter("key is not null and vec_id is not null")
    rows = written(rows, "vectors")
    # parts of one length are numbered from its offset
    models: dict[int, tuple[int, Router | None, int]] = {}
    offset = 0
    for i, (dim, n) in enumerate(V.lengths(rows).items()):
        parts = min(MOST, max(FEWEST, n // part_rows)) if i < V.MODELS else 1
        router, probes = fit(V.fit_sample(rows, dim, n), parts, k, recall) if parts > 1 else (None, 1)
        models[dim] = offset, router, probes
        offset += parts if router else 1
    if not models:
        return nothing
    shared = spark.sparkContext.broadcast(models)

    def route(batches):
        for batch in batches:
            cells: list[np.ndarray] = [np.zeros(0, np.int32)] * batch.num_rows
            for dim, at, x in V.by_length(batch):
                first, router, probes = shared.value[dim]
                place = np.argsort(-router.scores(V.units(x)), axis=1, kind="stable")[:, :probes] if router else np.zeros((len(x), 1), int)
                for i, p in zip(at, (first + place).astype(np.int32), strict=True):
                    cells[i] = p
            home = pa.array([int(c[0]) for c in cells], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, home, pa.array(cells, pa.list_(pa.int32()))], names=["vec_id", "asked", "key", "n_dim", "vec", "cell", "cells"])

    routed = rows.select("vec_id", "asked", "key", "n_dim", "vec").mapInArrow(route, "vec_id long, asked boolean, key binary, n_dim int, vec binary, cell int, cells array<int>")
    routed = written(routed, "routed")
    # the key deals rows out to blocks, so equal vectors get one that is their own
    routed = routed.withColumn("key", F.concat("key", F.col("vec_id").cast("string").cast("binary")))
    index = V.blocks_of({r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}, BLOCK)
    asked = routed.filter("asked").select("vec_id", "key", "vec", F.explode("cells").alias("cell"))
    lists = V.blocks_of({r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}, QUERIES)
    if not lists:
        return nothing
    blobs = written(packed(V.dealt(routed, index), "block", ["vec_id", "vec"]), "index")
    qblobs = written(packed(V.dealt(asked, lists), "block", ["vec_id", "vec"]), "queries")
    # a row a part goes to the executors, and there becomes a row for each pair of its blocks
    spread = lambda blocks, c: spark.createDataFrame([(cell, a, n) for cell, (a, n) in blocks.items()], "cell int, first int, n int").select("cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias(c))
    wanted = spread(lists, "q").join(spread(index, "i"), "cell").select("q", "i", F.xxhash64("q", "i").alias("pair"))
    side = lambda c, n, blocks: wanted.select("pair", F.col(c).alias("block")).join(blocks, "block").select("pair", F.lit(n).alias("side"), "data")
    sides = side("q", 0, qblobs).unionByName(side("i", 1, blobs))

    def compare(group: pa.Table) -> pa.Table:
        data = {int(s): unpacked(d) for s, d in zip(group.column("side").to_pylist(), group.column("data").to_pylist(), strict=True)}
        qi, xi = data[0].column("vec_id").to_numpy(), data[1].column("vec_id").to_numpy()
        q, x = V.matrix(data[0].column("vec").to_pylist()), V.matrix(data[1].column("vec").to_pylist())
        uq, ux = V.units(q), V.units(x)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q), 256):
            g = uq[at : at + 256] @ ux.T
            g[qi[at : at + 256][:, None] == xi[None, :]] = -9
            edge = np.partition(g, -min(k, g.shape[1]), axis=1)[:, -min(k, g.shape[1])]
            a, b = np.nonzero((g >= edge[:, None] - 1e-12) & (g > -9))
            s = _exact(q[a + at], x[b])
            order = np.lexsort((xi[b], -s, a))
            a, b, s = a[order], b[order], s[order]
            first = np.searchsorted(a, a)
            keep = np.arange(len(a)) - first < k
            found.append((qi[a[keep] + at], xi[b[keep]], s[keep]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    near = written(sides.groupBy("pair").applyInArrow(compare, "query_id long, vec_id long, score double"), "near").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
