import hashlib
import random

import numpy as np
import pytest

from tests.llm import brute
from tests.oracle import DATA
from tidemark.llm import catalogue, confirm, crowded, minhash, repeats, shingles
from tidemark.llm.components import components, spanning


def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_near_duplicates_equal_brute_force(spark, sf):
    got = catalogue.QUERIES["op4_minhash_dedup"](spark, f"{DATA}/{sf}").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near(documents(spark, sf), 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize(("edits", "block"), [(2, 1024), (4, 1024), (4, 40), (3, 100)])
def test_large_group_of_near_copies(spark, monkeypatch, edits, block):
    """With four edits most pairs lie just below the threshold, and few link; small blocks and parts cut the group into many."""
    monkeypatch.setattr(confirm, "TEXTS", block)
    monkeypatch.setattr(crowded, "PART", block)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = list(base)
        for j in rnd.sample(range(300), edits):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{rnd.randrange(10**9)}" for _ in range(50)) + " " + " ".join(base[:12])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.near(rows, 5)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "y"), (4, "A b", "y"), (5, "a\x0bB", None), (6, "a b", "z"), (7, long, "z"), (8, long + " tail", "z"), (9, "a b", "z"), (9, "a b", "z"), (None, "a b", "z"), (10, "É b c d e", None), (11, "é b c d e", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    n = len(shingles.shingle_sets([long], 5)[0])
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, n, 7, True), (8, n + 1, 7, False), (9, 1, 4, False), (9, 1, 4, False), (None, 1, 4, False), (10, 1, 10, True), (11, 1, 11, True)]
    assert got == sorted(want, key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(9, 9), (7, 8), (8, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {7: 7, 8: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repeats_equal_brute_force(spark, sf):
    got = catalogue.QUERIES["op9_repeats"](spark, f"{DATA}/{sf}").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.repeats(documents(spark, sf))


def test_repeats_over_many_chunks(spark, monkeypatch):
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abcd é\n") for _ in range(rnd.choice([40, 90, 99, 100, 101, 130, 300]))) for _ in range(40)]
    rows = [(i * 7 % 401, "".join(rnd.choice(parts) if rnd.random() < 0.6 else str(rnd.random()) for _ in range(rnd.randrange(0, 9)))) for i in range(400)]
    rows += [(900, "ab" * 400), (901, "q" * 99), (902, "q" * 100), (903, "q" * 250)]
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.repeats(rows)


def test_repeats_of_odd_rows(spark):
    a, sha = "0123456789" * 30, lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "short", None), (None, "z" + "".join(map(str, range(900))), "x"), (6, "".join(map(str, range(900))), "x"), (7, "x" * 99, "y"), (7, "x" * 99, "y"), (8, "".join(map(chr, range(200, 330))), "y"), (8, "".join(map(chr, range(200, 330))), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    got = sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=repr)
    u = rows[8][1]
    n = len(u.encode())
    want = [(1, 0, 0, 0, sha("")), (2, 0, 0, 0, sha("")), (3, 5, 0, 0, sha("short")), (4, 5, 0, 0, sha("short")), (None, 2591, 2590, 1, sha("z")), (6, 2590, 0, 0, sha(rows[5][1])), (7, 99, 0, 0, sha("x" * 99)), (7, 99, 0, 0, sha("x" * 99)), (8, n, 0, 0, sha(u)), (8, n, n, 1, sha(""))]
    assert got == sorted(want, key=repr) and a
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_cover_meets_every_difference():
    c = repeats.COVER
    assert {int(d) for d in (c[:, None] - c[None, :]).ravel() % repeats.PERIOD} == set(range(repeats.PERIOD))


def test_word_hashes_do_not_depend_on_neighbours():
    a = shingles.shingle_sets(["x y z w v", "", None, "Q x y z w", "x y"], 4)
    b = [shingles.shingle_sets([t], 4)[0] for t in ("x y z w v", "", None, "Q x y z w", "x y")]
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert [len(x) for x in a] == [2, 0, 0, 2, 1] and len(np.intersect1d(a[0], a[3])) == 1


def test_repeated_id_with_two_texts_loses_only_the_copy(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b"))
    rows = [(1, a, "x"), (5, a + " tail", "x"), (5, b, "y"), (5, b, "y"), (5, None, "y"), (6, b + " tail", "z"), (7, a, "z"), (8, "c", "z")]
    got = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[7]], key=repr)


def test_rows_without_doc_id_are_bridges(spark):
    w = [f"w{i}" for i in range(60)]
    ends, bridge = (" ".join([*(f"h{i}" for i in range(10)), *w]), " ".join([*w, *(f"t{i}" for i in range(10))])), " ".join(w)
    assert {c for _, c in brute.near([(3, ends[0]), (4, ends[1])], 5).values()} == {3, 4}
    rows = [(3, ends[0]), (4, ends[1]), (None, bridge), (None, bridge), (None, "other words"), (9, "far away from all")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted([(3, 3), (4, 3), (None, 3), (None, 3), (None, None), (9, 9)], key=repr)


def test_null_row_whose_near_copy_has_the_greater_id(spark):
    w = [f"w{i}" for i in range(61)]
    rows = [(1, " ".join(w)), (None, " ".join(w[:60]))]
    assert {c for _, c in brute.near([(1, rows[0][1]), (2, rows[1][1])], 5).values()} == {1}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, None: 1}


def test_links_are_those_of_all_pairs(monkeypatch):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(confirm, "COLUMNS", 50)
    pool = rnd.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[pool[: rnd.integers(1, 400)], rnd.integers(0, 2**63, rnd.integers(0, 60)).astype(np.uint64)]) for _ in range(60)]
    want = {(i, k) for i in range(60) for k in range(60) if shingles.similar(sets[i], sets[k], 80)}
    others = {(i, k) for i, k in zip(*map(np.ndarray.tolist, confirm.links(sets, sets, 80))) if i != k}
    assert others == {(i, k) for i, k in want if i != k}
    copies = [s.copy() for s in sets[:30]]
    assert set(zip(*map(np.ndarray.tolist, confirm.links(copies, sets, 80)))) == {(i, k) for i, k in want if i < 30}


def test_regions_are_as_deep_as_their_runs_need():
    rows = np.zeros((3 * minhash.WINDOW, minhash._LENGTH), np.uint8)
    rows[minhash.WINDOW + 5 :, 4] = 1  # another first value
    rows[2 * minhash.WINDOW + 9 :, 8] = 1  # another second value
    rows[:, minhash._KEY_AT + 15] = np.arange(len(rows))
    depth, start = minhash.regions(rows)
    w = minhash.WINDOW
    assert set(depth[: w + 5]) == {minhash.DEPTH + 1} and set(depth[w + 5 : 2 * w + 9]) == {minhash.DEPTH + 1}
    assert set(depth[2 * w + 9 :]) == {2} and set(start[2 * w + 9 :]) == {2 * w + 9}


def test_reach_joins_what_pairs_would_join():
    rnd = np.random.default_rng(6)
    sig = rnd.integers(0, 3, (300, 96)).astype(np.uint8)
    size, label = np.full(300, 50), rnd.integers(0, 120, 300)
    near = (sig[:, None, :] == sig[None]).sum(2) >= 45
    want = spanning(120, *(label[x] for x in np.nonzero(near)))
    pairs = crowded.reach(label, sig, size, 80, 45)
    assert all(near[i, k] for i, k in pairs)
    assert np.array_equal(spanning(120, *(label[[p[c] for p in pairs]] for c in (0, 1))), want)
