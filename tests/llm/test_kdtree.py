import numpy as np
import pytest
from pyspark.sql import functions as F

from credsift.llm import kdtree


def by_hand(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def search(spark, rows, queries, **more):
    vectors, asked = (spark.createDataFrame(x, "id long, v array<double>") for x in (rows, queries))
    return sorted(map(tuple, kdtree.top_k(vectors, asked, **more).collect()))


@pytest.mark.parametrize("n, dim, k, shard, block", [(400, 8, 5, 60, 7), (300, 3, 1, 1000, 1000), (50, 2, 60, 20, 4)])
def test_against_brute_force(spark, monkeypatch, n, dim, k, shard, block):
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 8)
    rnd = np.random.default_rng(n)
    rows = [(int(i) * 7, rnd.integers(-6, 7, dim).astype(float).tolist()) for i in range(n)]
    rows += [(10_000 + i, [2.0] * dim) for i in range(40)]  # many copies of one vector
    queries = rows[::9]
    assert search(spark, rows, queries, k=k, shard_rows=shard, block_rows=block) == by_hand(rows, queries, k)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0]), (3, None), (None, [5.0, 5.0]), (4, [0.0, 0.0]), (5, []), (6, [1.0, -1.0])]
    got = search(spark, rows, rows, k=2)
    assert got == by_hand([(i, v) for i, v in rows if i is not None and v is not None], [(i, v) for i, v in rows if i is not None and v is not None], 2)
    assert search(spark, [], [], k=3) == [] and search(spark, rows, [], k=3) == []


def test_finite(spark):
    rows = [([1.0],), ([None],), ([float("nan")],), ([float("-inf")],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(kdtree.finite(F.col("v"))).collect()]
    assert got == [True, False, False, False, False, True]


def test_boxes_hold_their_rows():
    values = np.random.default_rng(1).integers(-50, 50, (500, 4)).astype(float)
    leaves = list(kdtree.split(values, 20))
    assert sorted(i for _, r in leaves for i in r.tolist()) == list(range(500))
    tree = kdtree.Tree([n for n, _ in leaves], [r for _, r in leaves], [values[r] for _, r in leaves])
    root = tree.place[1]
    assert (tree.low[root] == values.min(axis=0)).all() and (tree.high[root] == values.max(axis=0)).all()


def test_bar_from_another_shard_prunes(monkeypatch):
    values = np.array([[float(i)] for i in range(100)])
    tree = kdtree.Tree(*zip(*[(n, r.astype(np.int64), values[r]) for n, r in kdtree.split(values, 10)]))
    assert tree.search(np.array([[1.0]]), np.array([-1]), 2, [None]) in ([[(98.0, 98), (99.0, 99)]], [[(99.0, 99), (98.0, 98)]])
    assert tree.search(np.array([[1.0]]), np.array([-1]), 2, [(1000.0, 5)]) == [[]]
