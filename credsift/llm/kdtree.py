"""Exact top-k by inner product: one KD-tree per shard, best-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsift.session import materialise

#: Rows of a shard, of a block of queries, and of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 4096, 128
EXACT = float(1 << 53)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def split(values: np.ndarray, most: int = LEAF_ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows) of the leaves; node n has the children 2n and 2n + 1.

    A node is halved at the median of its widest dimension, by position, so
    equal values are halved too.
    """
    todo = [(1, np.arange(len(values)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= most:
            yield node, rows
            continue
        part = values[rows]
        wide = np.argmax(part.max(axis=0) - part.min(axis=0)) if part.shape[1] else 0
        order = np.argpartition(part[:, wide], len(rows) // 2) if part.shape[1] else np.arange(len(rows))
        todo += [(2 * node, rows[order[: len(rows) // 2]]), (2 * node + 1, rows[order[len(rows) // 2 :]])]


class Tree:
    """Leaves of a shard, with a tight box around every node."""

    def __init__(self, nodes: list[int], ids: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.ids, self.values = dict(zip(nodes, ids)), dict(zip(nodes, values))
        boxes = {n: (v.min(axis=0), v.max(axis=0), int(i.min())) for n, i, v in zip(nodes, ids, values)}
        for n in sorted(nodes, key=int.bit_length, reverse=True):
            while n > 1:
                n //= 2
                if 2 * n not in boxes or 2 * n + 1 not in boxes:
                    break
                (la, ha, ia), (lb, hb, ib) = boxes[2 * n], boxes[2 * n + 1]
                boxes[n] = np.minimum(la, lb), np.maximum(ha, hb), min(ia, ib)
        self.nodes = sorted(boxes)
        self.place = {n: i for i, n in enumerate(self.nodes)}
        self.low = np.array([boxes[n][0] for n in self.nodes])
        self.high = np.array([boxes[n][1] for n in self.nodes])
        self.least_id = [boxes[n][2] for n in self.nodes]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: list[tuple[float, int] | None]) -> list[list[tuple[float, int]]]:
        """The k best (score, id) of every query, none worse than its ``kth`` so far.

        A box bounds the product of all it holds: in each dimension the end that
        suits the query.  Nodes are taken in order of their bounds, until the next
        bound is below the kth best, or equal to it with larger ids only.
        """
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        found = []
        for q in range(len(queries)):
            bound, best = bounds[q], []  # a heap of (score, -id), the worst on top
            limit = (kth[q][0], -kth[q][1]) if kth[q] is not None else None
            queue = [(-bound[self.place[1]], 1)]
            while queue:
                top, node = heapq.heappop(queue)
                at = self.place[node]
                if limit is not None and (-top < limit[0] or (-top == limit[0] and -self.least_id[at] < limit[1])):
                    if -top < limit[0]:
                        break
                    continue
                if node not in self.ids:
                    for child in (2 * node, 2 * node + 1):
                        heapq.heappush(queue, (-bound[self.place[child]], child))
                    continue
                ids, scores = self.ids[node], self.values[node] @ queries[q]
                good = ids != own[q]
                if limit is not None:
                    good &= scores >= limit[0]
                for item in zip(scores[good].tolist(), (-ids[good]).tolist()):
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k and (limit is None or best[0] > limit):
                    limit = best[0]
            found.append([(s, -i) for s, i in best])
        return found


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dim, node, ids, values): the leaves of a tree per shard and dimension.

    Rows are dealt out evenly, whatever their ids or values, so no shard is
    larger than others.
    """
    n = vectors.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, by_dim = TaskContext.get().partitionId(), {}
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(sizes)]
            ids = batch.column("id").to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                by_dim.setdefault(dim, []).append((ids[rows], flat[starts[rows][:, None] + np.arange(dim)]))
        for dim, got in by_dim.items():
            ids, values = np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got])
            if dim * np.abs(values).max(initial=0) ** 2 >= EXACT:
                raise ValueError("components are too large for exact products")
            leaves = list(split(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(leaves), pa.int32()), pa.array([dim] * len(leaves), pa.int32()),
                 pa.array([n for n, _ in leaves], pa.int64()), pa.array([ids[r].tobytes() for _, r in leaves]),
                 pa.array([values[r].tobytes() for _, r in leaves])],
                ["shard", "dim", "node", "ids", "values"],
            )

    shards = max(1, -(-n // shard_rows))
    return materialise(vectors.repartition(shards).mapInArrow(run, "shard int, dim int, node long, ids binary, values binary"))


def _search(k: int):
    def run(leaves: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["block", "place", "query_id", "id", "score"]
        out = [[] for _ in names]
        if len(leaves) and len(queries):
            dim = leaves.column("dim")[0].as_py()
            ids = [np.frombuffer(b, np.int64) for b in leaves.column("ids").to_pylist()]
            values = [np.frombuffer(b, np.float64).reshape(len(i), dim) for i, b in zip(ids, leaves.column("values").to_pylist())]
            tree = Tree(leaves.column("node").to_pylist(), ids, values)
            vectors = np.array(queries.column("v").to_pylist(), np.float64).reshape(len(queries), dim)
            if dim * np.abs(vectors).max(initial=0) ** 2 >= EXACT:
                raise ValueError("components are too large for exact products")
            own = queries.column("id").to_numpy()
            so_far = [None if s is None else (s, i) for s, i in zip(queries.column("kth_score").to_pylist(), queries.column("kth_id").to_pylist())]
            best = tree.search(vectors, own, k, so_far)
            sizes = [len(b) for b in best]
            for c, name in enumerate(("block", "place", "id")):
                out[c] = np.repeat(queries.column(name).to_numpy(), sizes)
            out[3] = [i for b in best for _, i in b]
            out[4] = [int(s) for b in best for s, _ in b]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product with each query.

    Both tables: id long, v array<double> of whole numbers.  Rows with a null
    id or vector take no part; vectors of different dimensions do not meet; a
    row is no candidate for a query of its own id.  Ties go to the smaller id.

    The queries are cut into blocks, and every block visits every shard: first
    one shard, whose kth score is then the bar in all others, so that most of
    their boxes are never opened.  Returns query_id, rank (from 1), id, score.
    """
    vectors, queries = (x.where("id is not null and v is not null") for x in (vectors, queries))
    leaves = build_index(vectors, shard_rows)
    shards = leaves.select("shard", "dim").distinct()
    n_blocks = max(1, -(-queries.count() // block_rows))
    blocks = materialise(
        queries.repartition(n_blocks).withColumn("block", F.spark_partition_id()).withColumn("dim", F.size("v"))
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int"))
    )
    # which shards a block visits: one first, then the others
    visits = blocks.select("block", "dim").distinct().join(shards, "dim").withColumn(
        "turn", F.row_number().over(Window.partitionBy("block", "dim").orderBy(F.pmod(F.col("shard") - F.col("block"), F.lit(1 << 30)), "shard"))
    )
    visits = materialise(visits)

    def visit(turn: Column, asked: DataFrame) -> DataFrame:
        cells = visits.where(turn).select("block", "dim", "shard")
        a = leaves.join(cells, ["shard", "dim"]).groupBy("shard", "block", "dim")
        b = asked.join(cells, ["block", "dim"]).groupBy("shard", "block", "dim")
        return a.cogroup(b).applyInArrow(_search(k), "block int, place int, query_id long, id long, score long")

    none = (F.lit(None).cast("double").alias("kth_score"), F.lit(None).cast("long").alias("kth_id"))
    first = materialise(visit(F.col("turn") == 1, blocks.select("*", *none)))
    ranked = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    kth = (
        first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
        .select("block", "place", F.col("score").cast("double").alias("kth_score"), F.col("id").alias("kth_id"))
    )
    others = visit(F.col("turn") > 1, blocks.join(kth, ["block", "place"], "left"))
    return (
        first.unionByName(others).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
