"""Least depths in commit graphs of any size.

A history is cut, along its order, into blocks that one task holds with ease.
Inside a block only two kinds of commits matter to the others: those that are
entered from outside, and those outside that its edges lead to.  So each block
is replaced by weighted edges from its entries to the next entries on any way,
which gives a graph of entries only.  That graph is solved in the same way, and
then every block works out the depths of its own commits from those of its
entries.

Histories are narrow: few lines of work run beside each other at any time, so
the graph of entries is a small part of the commits, and a history of any
length takes as many levels as its length has digits to the base of the size
of a block.  No table is larger than a small multiple of the edges.  A graph
that entries do not make smaller is walked edge by edge instead.

A block is one row: its commits, and its edges as pairs of places in it.  Where an
edge leads is thus found where the block is cut; only ends that lie in other
blocks are looked up, and no edge is dealt to tasks by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.session import materialise

Batches = Iterator[pa.RecordBatch]

#: Commits in a block.
BLOCK = 4096
#: Part of the nodes that the entries may be for another level to pay.
WORTH = 0.5


def least_depths(nodes: DataFrame, tips: DataFrame, block: int = BLOCK) -> DataFrame:
    """``repo, node, depth``: least sum of ``weight`` on a way from a tip, for each node that has one.

    ``nodes`` (``repo, node, at, out``): each node once, with its edges ``out``, an
    array of structs ``parent, weight``; neighbours should be close by in the
    order of ``at``, newest first, which decides the work, not the result.
    Parents that are no nodes are passed over.
    ``tips`` (``repo, node, depth``): nodes and the depths they start with.
    """
    blocks = materialise(_blocks(nodes, block))
    at = F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("ats").alias("at"), F.sequence(F.lit(0), F.size("nodes") - 1).alias("pos")))
    places = blocks.select("repo", "block", at.alias("_n")).select("repo", "block", "_n.node", "_n.at", "_n.pos")
    far = blocks.select("repo", F.explode("far").alias("node"))
    entries = materialise(far.unionByName(tips.select("repo", "node")).distinct().join(places, ["repo", "node"]))
    known = tips
    if not far.isEmpty():
        if entries.count() > WORTH * (blocks.agg(F.sum(F.size("nodes"))).first()[0] or 0):
            edges = nodes.select("repo", "node", F.inline("out"))
            ends = nodes.select("repo", F.col("node").alias("parent"))
            known = _walk(materialise(edges.join(ends, ["repo", "parent"], "left_semi")), tips)
        else:
            held = F.struct("pos", "node").alias("entry")
            met = _per_block(_contract, blocks, entries.select("block", held), "parent string, weight long")
            upper = materialise(met.join(entries.select("repo", F.col("node").alias("parent")), ["repo", "parent"], "left_semi"))
            out = upper.groupBy("repo", "node").agg(F.collect_list(F.struct("parent", "weight")).alias("out"))
            known = least_depths(entries.select("repo", "node", "at").join(out, ["repo", "node"], "left"), tips, block)
    start = F.struct("pos", F.col("depth").cast("long").alias("depth")).alias("entry")
    return _per_block(_solve, blocks, entries.join(known, ["repo", "node"]).select("block", start), "depth long")


def commit_nodes(commits: DataFrame, weight: int) -> DataFrame:
    """``repo, node, at, out`` of commits, each commit once, with edges of one weight to its parents.

    A commit that stands in several rows has the parents of all of them; only
    such rows are put together, told by a hash of eight bytes per row.
    """
    rows = commits.select("repo", F.col("hash").alias("node"), F.col("committer_when").alias("at"), "parents")
    keyed = rows.withColumn("_key", F.xxhash64("repo", "node"))
    twice = materialise(keyed.groupBy("_key").count().where(F.col("count") > 1).select("_key"))
    if not twice.isEmpty():
        same = keyed.join(twice, "_key", "left_semi").groupBy("repo", "node").agg(
            F.max("at").alias("at"), F.flatten(F.collect_list("parents")).alias("parents")
        )
        rows = keyed.join(twice, "_key", "left_anti").drop("_key").unionByName(same)
    edge: Callable[[Column], Column] = lambda p: F.struct(p.alias("parent"), F.lit(weight).cast("long").alias("weight"))
    named = F.array_distinct(F.filter("parents", lambda p: p.isNotNull()))
    return rows.select("repo", "node", "at", F.when(F.col("node").isNotNull(), F.transform(named, edge)).alias("out"))


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """A row for each block of at most ``size`` nodes of one repository that follow each other.

    ``src, dst, weights`` are the edges inside it, as places in ``nodes``;
    ``far_src, far, far_weights`` those that leave it, with the name they lead to.
    """
    order = [F.col("repo").asc(), F.col("at").desc_nulls_last(), F.col("node").asc()]

    def pack(number: int, repo: str | None, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        names, out = (rows[c].combine_chunks() for c in ("node", "out"))
        parents, weights = out.flatten().flatten()
        src = np.repeat(np.arange(len(names), dtype=np.int32), pc.fill_null(pc.list_value_length(out), 0).to_numpy())
        dst = pc.index_in(parents, value_set=names)
        inside, outside = dst.is_valid(), dst.is_null()
        src = pa.array(src, pa.int32())
        columns = (
            names, rows["at"].combine_chunks(), src.filter(inside), dst.filter(inside), weights.filter(inside),
            src.filter(outside), parents.filter(outside), weights.filter(outside),
        )
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([repo], pa.string()), pa.array([number], pa.int64()), *lists], names=list(kinds))

    def run(batches: Batches) -> Batches:
        number, repo, n = TaskContext.get().partitionId() << 40, None, 0
        held: list[pa.RecordBatch] = []
        for batch in batches:
            start = 0
            for i, r in enumerate(batch.column("repo").to_pylist()):
                if n and (r != repo or n == size):
                    yield pack(number, repo, [*held, batch.slice(start, i - start)])
                    number, n, held, start = number + 1, 0, [], i
                repo, n = r, n + 1
            held.append(batch.slice(start))
        if n:
            yield pack(number, repo, held)

    slim = nodes.select("repo", "node", "at", "out")
    kinds = {
        "repo": "string", "block": "long", "nodes": "array<string>", "ats": f"array<{slim.schema['at'].dataType.simpleString()}>",
        "src": "array<int>", "dst": "array<int>", "weights": "array<long>",
        "far_src": "array<int>", "far": "array<string>", "far_weights": "array<long>",
    }
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def _per_block(work: Callable[[dict], Sequence], blocks: DataFrame, entries: DataFrame, result: str) -> DataFrame:
    """``work`` on each block and its ``entries``; ``result`` are its columns after repo and node."""
    held = entries.groupBy("block").agg(F.collect_list("entry").alias("entries"))
    rows = blocks.join(held, "block").select("repo", *NEEDS[work], "entries")
    kinds = [pa.string(), pa.string(), *[{"string": pa.string(), "long": pa.int64()}[part.split()[1]] for part in result.split(", ")]]
    names = ["repo", "node", *[part.split()[0] for part in result.split(", ")]]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].values if c != "repo" else batch.column(c)[i].as_py() for c in batch.schema.names}
                found = work(row)
                if len(found[0]):
                    columns = [pa.array(list(repeat(row["repo"], len(found[0]))), pa.string()), *found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds)], names=names)

    return rows.mapInArrow(run, f"repo string, node string, {result}")


def _edges(src: pa.Array, dst: pa.Array, weights: pa.Array) -> tuple[np.ndarray, list, list[int]]:
    """The sources, in order, of edges, and where they lead."""
    return src.to_numpy(), dst.to_pylist(), weights.to_pylist()


def _firsts(src: np.ndarray, n: int) -> list[int]:
    """Where the edges of each of ``n`` nodes begin, and where the last ones end."""
    return np.searchsorted(src, np.arange(n + 1)).tolist()


def _solve(row: dict) -> Sequence:
    """Depths inside a block, from those known in it."""
    names = row["nodes"]
    src, dst, weights = _edges(row["src"], row["dst"], row["weights"])
    first = _firsts(src, len(names))
    best: dict[int, int] = {}
    for node, depth in zip(*(c.to_pylist() for c in row["entries"].flatten())):
        best[node] = min(depth, best.get(node, depth))
    heap = [(d, n) for n, d in best.items()]
    heapify(heap)
    while heap:
        depth, node = heappop(heap)
        if depth > best[node]:
            continue
        for e in range(first[node], first[node + 1]):
            parent, far = dst[e], depth + weights[e]
            if far < best.get(parent, far + 1):
                best[parent] = far
                heappush(heap, (far, parent))
    return names.take(pa.array(list(best), pa.int32())), list(best.values())


def _contract(row: dict) -> Sequence:
    """Edges from each entry to the entries, here or outside, that come next on any way."""
    src, dst, weights = _edges(row["src"], row["dst"], row["weights"])
    far_src, far_dst, far_weights = _edges(row["far_src"], row["far"], row["far_weights"])
    entries = dict(zip(*(c.to_pylist() for c in row["entries"].flatten())))
    size = 1 + max(*entries, *src.tolist(), *dst, *far_src.tolist(), 0)
    first, far_first = _firsts(src, size), _firsts(far_src, size)
    found: tuple[list, list, list] = ([], [], [])
    for entry, name in entries.items():
        best, heap = {entry: 0}, [(0, entry)]
        reached: dict[str, int] = {}
        while heap:
            depth, node = heappop(heap)
            if depth > best[node]:
                continue
            for e in range(far_first[node], far_first[node + 1]):
                reached[far_dst[e]] = min(depth + far_weights[e], reached.get(far_dst[e], depth + far_weights[e]))
            for e in range(first[node], first[node + 1]):
                parent, far = dst[e], depth + weights[e]
                if parent in entries:
                    reached[entries[parent]] = min(far, reached.get(entries[parent], far))
                elif far < best.get(parent, far + 1):
                    best[parent] = far
                    heappush(heap, (far, parent))
        reached.pop(name, None)
        for column, values in zip(found, (repeat(name, len(reached)), reached, reached.values())):
            column.extend(values)
    return found


#: The columns of a block that each kind of work reads.
NEEDS = {_solve: ("nodes", "src", "dst", "weights"), _contract: ("src", "dst", "weights", "far_src", "far", "far_weights")}


def _walk(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """Depths by rounds, each from the nodes that the last one brought nearer."""
    known = materialise(tips.select("repo", "node", F.col("depth").cast("long").alias("depth")))
    nearer = known
    while not nearer.isEmpty():
        met = nearer.join(edges, ["repo", "node"]).select(
            "repo", F.col("parent").alias("node"), (F.col("depth") + F.col("weight")).alias("depth")
        )
        met = met.groupBy("repo", "node").agg(F.min("depth").alias("depth"))
        before = known.withColumnRenamed("depth", "_before")
        nearer = materialise(
            met.join(before, ["repo", "node"], "left").where("_before is null or depth < _before").select("repo", "node", "depth")
        )
        known = materialise(known.unionByName(nearer).groupBy("repo", "node").agg(F.min("depth").alias("depth")))
    return known
