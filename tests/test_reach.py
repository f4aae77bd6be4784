"""Reachability over histories that are cut into blocks, against a search in memory."""

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest

from credsift import schemas
from credsift.operators import reach
from credsift.operators.history import reachable_commits

DAY = datetime(2026, 1, 1, tzinfo=timezone.utc)


def tables(spark, history, refs):
    """``history``: repo -> list of lists of parents by number; ``refs``: (repo, name, type, number)."""
    commits = [
        (repo, f"{repo}-{i}", [f"{repo}-{p}" for p in parents], "m", "a", DAY, DAY + timedelta(minutes=i))
        for repo, rows in history.items() for i, parents in enumerate(rows)
    ]
    named = [(repo, name, kind, f"{repo}-{i}") for repo, name, kind, i in refs]
    return spark.createDataFrame(named, schemas.REFS), spark.createDataFrame(commits, schemas.COMMITS)


def search(history, refs):
    out = {}
    for repo, rows in history.items():
        queue = deque((i, 0) for r, _, kind, i in refs if r == repo and kind == "hash" and i < len(rows))
        while queue:
            i, depth = queue.popleft()
            if (repo, i) not in out:
                out[repo, i] = depth
                queue.extend((p, depth + 1) for p in rows[i] if p < len(rows))
    return {f"{repo}-{i}": d for (repo, i), d in out.items()}


def found(spark, history, refs, block, monkeypatch):
    monkeypatch.setattr(reach.least_depths, "__defaults__", (block,))
    rows = reachable_commits(*tables(spark, history, refs)).collect()
    depths = {r.hash: r.depth for r in rows}
    assert len(depths) == len(rows)
    return depths


def merging(n, seed):
    """A main line with side branches that fork off it, run beside it and are merged; some are left open."""
    rng, rows, branches = random.Random(seed), [[]], []
    main = 0
    for i in range(1, n):
        if branches and rng.random() < 0.3:
            b = rng.randrange(len(branches))
            rows.append([branches[b]])
            branches[b] = i
            continue
        parents = [main]
        if branches and rng.random() < 0.25:
            parents.append(branches.pop(rng.randrange(len(branches))))
        elif len(branches) < 4 and rng.random() < 0.2:
            branches.append(i - 1)
        rows.append(parents)
        main = i
    return rows


def test_long_history(spark, monkeypatch):
    """10,000 commits with merges, several refs, one repository with most of them, and commits that no ref reaches."""
    history = {"big": merging(10_000, 1), "mid": merging(900, 2), "one": [[]]}
    refs = [
        ("big", "refs/heads/main", "hash", 9_800), ("big", "refs/heads/old", "hash", 5_000), ("big", "refs/tags/t", "hash", 3_333),
        ("big", "HEAD", "symbolic", 9_999), ("mid", "refs/heads/main", "hash", 500), ("one", "refs/heads/main", "hash", 0),
    ]
    want = search(history, refs)
    assert found(spark, history, refs, 256, monkeypatch) == want and len(want) < 10_901


@pytest.mark.parametrize("block", [3, 16])
def test_any_graph(spark, monkeypatch, block):
    """Parents anywhere, also newer than their children: the order decides the work only."""
    rng = random.Random(block)
    history = {"a": [[rng.randrange(120) for _ in range(rng.randrange(3))] for _ in range(100)], "b": merging(80, 3)}
    refs = [("a", "x", "hash", 99), ("a", "y", "hash", 7), ("b", "x", "hash", 79), ("b", "gone", "hash", 500)]
    assert found(spark, history, refs, block, monkeypatch) == search(history, refs)


def test_tables_stay_small(spark, monkeypatch):
    """No table of any level has more rows than the edges, where lines of work are few."""
    sizes, write = [], reach.materialise

    def counted(df):
        table = write(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(reach, "materialise", counted)
    history = {"a": [[p for p in (i - 1, i - 3 if i % 7 == 0 else -1) if p >= 0] for i in range(3_200)]}
    refs = [("a", "main", "hash", 3_199)]
    assert found(spark, history, refs, 64, monkeypatch) == search(history, refs)
    assert max(sizes) <= sum(map(len, history["a"])) and len(sizes) < 15


def test_nothing(spark, monkeypatch):
    assert found(spark, {}, [], 8, monkeypatch) == {}
    assert found(spark, {"a": [[], [0]]}, [("a", "t", "symbolic", 1)], 8, monkeypatch) == {}


def test_no_table_has_a_row_per_commit(spark, monkeypatch):
    """Blocks are rows, and edges inside them are dealt to no task by themselves."""
    sizes, write = [], reach.materialise

    def counted(df):
        table = write(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(reach, "materialise", counted)
    history = {"a": [[p for p in (i - 1, i - 3 if i % 7 == 0 else -1) if p >= 0] for i in range(3_200)]}
    refs = [("a", "main", "hash", 3_199)]
    assert found(spark, history, refs, 256, monkeypatch) == search(history, refs)
    assert max(sizes) <= 3_200 // 20


def test_commit_in_several_rows(spark):
    """It has the parents of all its rows, wherever their times put them."""
    refs, commits = tables(spark, {"a": [[], [], [0], [2], [3]]}, [("a", "x", "hash", 4)])
    again = tables(spark, {"a": [[], [], [1], []]}, [])[1].where("size(parents) > 0")
    late = again.withColumn("committer_when", again.committer_when + timedelta(days=9))
    got = {r.hash: r.depth for r in reachable_commits(refs, commits.unionByName(late).unionByName(commits)).collect()}
    assert got == {"a-4": 0, "a-3": 1, "a-2": 2, "a-0": 3, "a-1": 3}
