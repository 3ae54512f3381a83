import math

import numpy as np
import pytest

from tests.oracle import DATA
from tidemark.llm import ann, catalogue, embedding_dedup

BAD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0]]


def read(sf, spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").collect()]
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    return ids, x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_links(ids, u, threshold=0.9):
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], ids.max() + 1).min(1))
        if (new == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label, strict=True)}
        label = new


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_links_equal_brute_force(spark, sf):
    got = catalogue.QUERIES["op8_embedding_dedup"](spark, f"{DATA}/{sf}").collect()
    want = brute_links(*read(sf, spark))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_links_across_cells_and_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 8))
    x = np.concatenate([base + 0.2 * rng.standard_normal(base.shape) for _ in range(5)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df, block=40, cell_rows=20).collect()
    u = x.astype(np.float64)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(np.arange(len(x)), u / np.linalg.norm(u, axis=1, keepdims=True))


def test_links_of_odd_rows(spark):
    rows = [(i, v, "x") for i, v in enumerate(BAD)] + [(10, [1.0, 0.0, 0.0], "y"), (11, [1.0, 0.0, 0.0], "y"), (11, [1.0, 0.0, 0.0], None), (12, [2.0, 0.1, 0.0], "z"), (13, [-1.0, 0.0, 0.0], "z"), (14, [1.0, 0.0], "short"), (None, [1.0, 0.0, 0.0], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    want = [(i, 0, i, True) for i in range(6)] + [(10, 3, 10, True), (11, 3, 10, False), (11, 3, 10, False), (12, 3, 10, False), (13, 0, 13, True), (14, 0, 14, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_search_recall(spark):
    sf = f"{DATA}/sf0.1"
    ids, u = read("sf0.1", spark)
    got = {}
    for r in catalogue.QUERIES["op10_ann"](spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        best = ids[np.argsort(-s, kind="stable")[:5]]
        assert len(got[ids[q]]) == 5
        hit += sum(int(b) in got[ids[q]] for b in best)
        total += 5
        for v, score in got[ids[q]].items():
            assert math.isclose(score, s[np.flatnonzero(ids == v)[0]], abs_tol=1e-12)
    assert hit / total >= 0.9


def test_search_ties_few_candidates_and_odd_rows(spark):
    rows = [(100 + i, v) for i, v in enumerate(BAD)] + [(0, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 1, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    many = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(200)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in ann.search(many, F.col("vec_id") == 50).orderBy("rank").collect()]
    assert got == [(50, i) for i in range(5)]


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(3)
    x = {d: np.concatenate([b := rng.standard_normal((40, d)), b + 0.1 * rng.standard_normal((40, d))]) for d in (5, 8)}
    rows = [(2 * i + (d == 8), v.tolist()) for d in x for i, v in enumerate(x[d])] + [(1000, [1.0, 0.0]), (1001, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {1000: (1, 1000), 1001: (1, 1000)}
    for d, m in x.items():
        ids = 2 * np.arange(len(m)) + (d == 8)
        want |= brute_links(ids, m / np.linalg.norm(m, axis=1, keepdims=True))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, block=30, cell_rows=20).collect()}
    assert got == want
    from pyspark.sql import functions as F

    found = {(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") >= 1000).collect()}
    assert found == {(1000, 1001), (1001, 1000)}
    near = {}
    for r in ann.search(df, F.col("vec_id") < 20).collect():
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(v) == 5 and {i % 2 for i in v} == {q % 2} for q, v in near.items()) and len(near) == 20


def test_search_recall_beside_a_hot_vector(spark):
    """Half of all rows are one vector; the others are found as well as without it."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20_000, 16))
    rows = [(i, v.tolist(), i % 400 == 0) for i, v in enumerate(x)] + [(100_000 + i, x[7].tolist(), False) for i in range(20_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, asked boolean")
    from pyspark.sql import functions as F

    got = {}
    for r in ann.search(df.withColumnRenamed("vec_id", "key"), F.col("asked"), vec_id="key").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 20_000, 400):
        s = u @ u[q]
        s[q] = -9
        hit += len(got[q] & {int(b) for b in np.argsort(-s, kind="stable")[:5]})
    assert hit / 250 >= 0.9
