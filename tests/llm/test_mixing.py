import re

import pytest
from pyspark.sql import functions as F

from credsift.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    return mixing.mix_sources(docs, mixing.word_count(F.col("text")), **more).collect()


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight, over and over, what is above its cap going back to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in full)
    return out


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5 if i % 3 else 0}") for i in range(3000)] + [(9000 + i, "a b", None) for i in range(50)]
    got = mixed(spark, rows)
    sizes, taken = {}, {}
    source, text = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        sizes[source[r["doc_id"]]] = sizes.get(source[r["doc_id"]], 0) + r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 7
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed(spark, rows[::-1])))


def test_order_is_by_virtual_finish_time(spark):
    """What is taken is the longest prefix of all passes in order of their finish times."""
    rows = [(i, "w " * (1 + i % 3), "ab"[i % 2]) for i in range(40)]
    got = {r["doc_id"]: r for r in mixed(spark, rows)}
    budget = 1.5 * sum(r["size"] for r in got.values())
    taken = sum(r["taken"] for r in got.values())
    assert budget - max(r["size"] for r in got.values()) <= taken <= budget


@pytest.mark.parametrize("rows", [
    [], [(1, None, None)], [(1, "", "a"), (1, "", "a")], [(None, "x y", None), (None, "x y", None), (2, "z", "")],
    [(1, "one", "a")] * 5, [(1, "w " * 50_000, "a"), (2, "w", "b")],
])
def test_odd_rows(spark, rows):
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    assert sum(r["taken"] for r in got) <= 1.5 * sum(r["size"] for r in got)
    assert all(r["copies"] == 0 for r in got if r["size"] == 0)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8)], "doc_id long, text string, source string, size int, target string")
    assert mixing.mix_sources(docs, mixing.word_count(F.col("text"))).collect()[0]["size"] == 2
