import tracemalloc

import numpy as np
import pyarrow as pa

from textmill.llm import neighbours as N


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -np.round(s[i], 12)))[:k]}


def frame(spark, x):
    return spark.createDataFrame([(i, v.astype(float).tolist(), "x") for i, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<FLOAT>, copy STRING")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    got = N.neighbours(frame(spark, x), 5, 16, sample=1000, leaf_size=64, asked=128)
    found = {(r["vec_a"], r["vec_b"]) for r in got.collect()}
    true = brute(x.astype(float), 5)
    assert len(found) == 15_000 and len(found & true) / len(true) > 0.97


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=8), (400, 1)), rng.normal(size=(300, 8))]).astype(np.float32)
    got = {}
    for r in N.neighbours(frame(spark, x), 5, 8, leaf_size=32).collect():
        got.setdefault(r["vec_a"], set()).add(r["vec_b"])
    assert got[399] == {0, 1, 2, 3, 4} and got[2] == {0, 1, 3, 4, 5} and all(len(v) == 5 for v in got.values())


def test_leaves_over_a_block_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 50)
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    found = {(r["vec_a"], r["vec_b"]) for r in N.neighbours(frame(spark, x), 3, 8, leaf_size=150).collect()}
    true = brute(x.astype(float), 3)
    assert len(found & true) / len(true) > 0.97


def test_invalid_few_and_none(spark):
    shape = "vec_id BIGINT, embedding ARRAY<FLOAT>"
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.1]), (None, [1.0, 1.0]), (7, [None, 1.0])]
    got = N.neighbours(spark.createDataFrame(rows, shape), 5, 2).collect()
    assert sorted((r["vec_a"], r["vec_b"]) for r in got) == [(1, 6), (6, 1)]
    assert N.neighbours(spark.createDataFrame([], shape), 5, 2).count() == 0
    assert N.neighbours(spark.createDataFrame(rows[:1], shape), 5, 2).count() == 0


def test_a_walk_holds_few_distances_at_a_time():
    rng = np.random.default_rng(4)
    c, x = rng.normal(size=(2001, 8)), rng.normal(size=(2000, 8))
    tree = N.Tree(list(c), [list(range(1, 2001))] + [[] for _ in range(2000)], list(range(-1, 2000)), 2000)
    tracemalloc.start()
    leaves = [next(iter(v)) for v in tree.visited(x, 1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert leaves == (x @ c[1:].T).argmax(axis=1).tolist() and peak < 30e6


def test_queries_of_a_block_are_answered_as_they_come():
    x = np.random.default_rng(5).normal(size=(60, 4)).astype(np.float32)
    read = []

    def batches():
        for cell, asks, rows in ((0, False, range(0, 20)), (0, False, range(20, 40)), (0, True, range(0, 30)), (0, True, range(30, 60)), (1, True, range(0, 9)), (2, False, range(40, 60)), (2, True, range(0, 5))):
            read.append((cell, asks))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([cell] * n, pa.int32()), pa.array(rows, pa.int64()), pa.array([x[i] for i in rows], pa.list_(pa.float32())), pa.array([[0]] * n, pa.list_(pa.int32())), pa.array([asks] * n)], ["cell", "vec_id", "embedding", "leaves", "asks"])

    got = N.answered(batches(), 3)
    first = next(got)
    assert len(read) == 3 and first.num_rows == 30
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for b, base in ((first, range(40)), (next(got), range(40)), (next(got), range(40, 60))):
        for r in b.to_pylist():
            assert [e["id"] for e in r["near"]] == sorted(base, key=lambda i: -(u[i] @ u[r["q"]]))[:3]
    assert next(got, None) is None


def test_large_tables_send_a_query_to_fewer_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 25)
    x = np.random.default_rng(7).normal(size=(2400, 8)).astype(np.float32)
    sent, ran = [], N.merged
    monkeypatch.setattr(N, "merged", lambda near, k: (sent.append(near.count()), ran(near, k))[1])
    found = {(r["vec_a"], r["vec_b"]) for r in N.neighbours(frame(spark, x), 3, 8, leaf_size=20).collect()}
    assert len(found & brute(x.astype(float), 3)) / 7200 > 0.97
    assert sent[-1] <= 24 * 2400 * 1.5
