"""MinHash near-dedup: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.llm.graph import connected_components
from credsift.llm.words import Words, carried, mix64, parts, seeds, words_of
from credsift.session import materialise

SHINGLE = 5
BINS = 128
BAND_ROWS = 4
SIMILARITY = 75  # percent
#: Elements that one step of a sketch hashes at least.
STEP = 2048
#: Shingles and rows of a block of sets, and columns that a task counts at a time.
CELL_SHINGLES, CELL_ROWS, CELL_COLUMNS = 250_000, 1024, 2048
#: Bins by which the sketches of a pair may fall short of its similarity: a pair at
#: 0.75 is further off once in 100 million, far more seldom than it shares no band.
SLACK = BINS // 4


def shingle_sets(words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of hashed shingles of each text, sorted; a shorter text is one shingle."""
    factors = seeds(11, size)
    n = len(words.hashes)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        whole += words.hashes[i : i + len(whole)] * factors[i]
    whole = mix64(whole)
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            part = words.hashes[a:b] * factors[: b - a]
            yield mix64(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty.

    In round i < bins every element goes to a bin of its hash, in round
    bins + j all go to bin j; a bin keeps the least (round, hash).  Rounds go on
    until every bin is filled, which the second half guarantees.  Rounds are
    hashed a few at a time: later ones never win over a filled bin.
    """
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    salts = seeds(12, 2 * bins)
    at = 0
    while at < 2 * bins:
        to = min(2 * bins, at + max(1, -(-STEP // len(elements))))
        if at < bins:
            to = min(to, bins)
        hashes = mix64(elements[None, :] ^ salts[at:to, None])
        rounds = np.arange(at, to, dtype=np.uint64)[:, None]
        if at < bins:
            places = (hashes & np.uint64(bins - 1)).astype(np.intp)
        else:
            places = np.broadcast_to((rounds - np.uint64(bins)).astype(np.intp), hashes.shape)
        np.minimum.at(least, places.ravel(), ((rounds << np.uint64(55)) | (hashes >> np.uint64(9))).ravel())
        if least.max() != np.iinfo(np.uint64).max:
            return least
        at = to
    return least


def bands(least: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` bins."""
    table = least.reshape(-1, rows) * seeds(13, rows)
    return mix64(table.sum(axis=1, dtype=np.uint64) + seeds(14, len(table)))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and 128-bit digest of every set."""
    sums = np.array([(len(s), s.sum(dtype=np.uint64), mix64(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return [pa.array(column) for column in sums.reshape(-1, 3).T.view(np.int64)]


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")


def sketched(docs: DataFrame) -> DataFrame:
    """(n, d1, d2, bands): size, 128-bit digest and band keys of every row's set, after the columns but ``text``."""
    along = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                sets = list(shingle_sets(words_of(part.column("text"), fold=True)))
                keys = [bands(sketch(s)) if len(s) else np.zeros(0, np.uint64) for s in sets]
                offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, along), *_digests(sets), pa.ListArray.from_arrays(offsets, flat)],
                    [*along, "n", "d1", "d2", "bands"],
                )

    return docs.mapInArrow(run, f"{_kinds(docs)}, n long, d1 long, d2 long, bands array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """(n, d1, d2, shingles, sketch): the whole set of every text that has words, and a byte per bin of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                sets = [s for s in shingle_sets(words_of(part.column("text"), fold=True)) if len(s)]
                if sets:
                    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                    flat = np.concatenate(sets).view(np.int64)
                    marks = [mix64(sketch(s)).astype(np.uint8).tobytes() for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [*_digests(sets), pa.ListArray.from_arrays(offsets, flat), pa.array(marks, pa.binary())],
                        ["n", "d1", "d2", "shingles", "sketch"],
                    )

    return texts.select("text").mapInArrow(run, "n long, d1 long, d2 long, shingles array<long>, sketch binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent)
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
        .where(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).select("a", "b")
    )


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    counts = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for flat, rows in ((flat_a, a), (flat_b, b)):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.searchsorted(both, flat)
        hit = both[np.minimum(at, len(both) - 1)] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order]))
    for lo in range(0, len(both), CELL_COLUMNS):
        tables, wide = [], min(CELL_COLUMNS, len(both) - lo)
        for rows, (row, at) in zip((a, b), sides):
            x, y = np.searchsorted(at, (lo, lo + wide))
            table = np.zeros((len(rows), wide), np.float32)
            table[row[x:y], at[x:y] - lo] = 1
            tables.append(table)
        counts += tables[0] @ tables[1].T
    return counts


def cell_links(cell: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Components of one cell that a pair of its sets links, as few as keep together what they link.

    The rows of block i outside the main component are held against those of
    block j: first by sketches and sizes, then, where these allow a link between
    two components that are not linked yet, by full sets.
    """
    first, second = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    block, part = cell.column("block").to_numpy(), cell.column("component").to_numpy()
    x = np.flatnonzero((block == first) & cell.column("outside").to_numpy())
    y = np.flatnonzero(block == second)
    if not len(x) or not len(y):
        return []
    marks = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(cell), -1)
    lists = cell.column("shingles").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    sizes = np.diff(offsets).astype(np.int64)
    least = marks.shape[1] * percent / 100 - SLACK
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    step = max(1, (1 << 23) // (len(y) * marks.shape[1]))
    for lo in range(0, len(x), step):
        rows = x[lo : lo + step]
        near = (marks[rows][:, None, :] == marks[y][None]).sum(axis=2, dtype=np.int32) >= least
        near &= part[rows][:, None] != part[y][None, :]
        low, high = np.minimum.outer(sizes[rows], sizes[y]), np.maximum.outer(sizes[rows], sizes[y])
        near &= low * 100 >= high * percent
        at, to = np.nonzero(near)
        many = len(at) > 4 * (len(rows) + len(y))
        shared = common([sets[r] for r in rows], [sets[r] for r in y]) if many else None
        for p, q in zip(at.tolist(), to.tolist()):
            a, b = int(rows[p]), int(y[q])
            one, other = find(int(part[a])), find(int(part[b]))
            if one == other:
                continue
            n = int(shared[p, q]) if many else len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if n * 100 >= (int(sizes[a] + sizes[b]) - n) * percent:
                root[one] = other
                links.append((int(part[a]), int(part[b])))
    return links


def cells_linked(percent: int):
    """Runs ``cell_links`` over rows that are sorted by cell; a task holds one cell and one batch."""

    def cuts(batch: pa.RecordBatch) -> list[int]:
        keys = np.stack([batch.column(c).to_numpy() for c in CELL])
        return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]

    def answer(cell: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = cell_links(pa.Table.from_batches(cell), percent)
        return pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not len(batch):
                continue
            edges = cuts(batch)
            for a, b in zip(edges[:-1], edges[1:]):
                key = tuple(batch.column(c)[a].as_py() for c in CELL)
                if held and key != name:
                    yield answer(held)
                    held = []
                name = key
                held.append(batch.slice(a, b - a))
        if held:
            yield answer(held)

    return run


#: What names a cell: a bucket and two of its blocks.
CELL = ("bucket", "i", "j")


def bucket_links(members: DataFrame, components: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(a, b): components that a pair of one bucket links, from all pairs of every bucket that are in two.

    ``members``: (bucket, node, n).  Of buckets with the same members one is
    taken.  The members outside a bucket's largest component are held against
    all its members.  A bucket of more than ``CELL_ROWS`` rows or
    ``CELL_SHINGLES`` shingles is dealt into blocks, those outside and those of
    the largest component apart; a cell is one block outside and one other, so a
    task holds two blocks whatever the size of the bucket.
    """
    placed = members.join(components, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = materialise(placed)
    prints = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), *prints)
    mixed = (
        sizes.groupBy("bucket").agg(
            F.max(F.struct("rows", "component", "shingles")).alias("main"), F.count(F.lit(1)).alias("components"),
            F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"),
        ).where("components > 1").groupBy("h1", "h2", "rows", "shingles").agg(F.min(F.struct("bucket", "main")).alias("b"))
    )

    def blocks(rows, shingles):
        return F.ceil(F.greatest(rows / CELL_ROWS, shingles / CELL_SHINGLES)).cast("int")

    few = blocks(F.col("rows"), F.col("shingles")) <= 1
    out = blocks(F.col("rows") - F.col("b.main.rows"), F.col("shingles") - F.col("b.main.shingles"))
    mixed = materialise(mixed.select(
        "b.bucket", F.col("b.main.component").alias("main"), F.when(few, 1).otherwise(out).alias("out"),
        F.when(few, 0).otherwise(blocks(F.col("b.main.rows"), F.col("b.main.shingles"))).alias("in"),
    ))
    outside, key = F.col("component") != F.col("main"), F.xxhash64("node", F.lit(3))
    block = F.when(outside | (F.col("in") == 0), F.pmod(key, F.col("out"))).otherwise(F.col("out") + F.pmod(key, F.col("in")))
    last = F.when(F.col("block") < F.col("out"), F.col("out") + F.col("in")).otherwise(F.col("out")) - 1
    celled = (
        placed.join(mixed, "bucket").withColumn("outside", outside).withColumn("block", block.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "outside", "node", "component")
    )
    dealt = celled.join(sets, "node").select(*CELL, "block", "outside", "component", "shingles", "sketch")
    dealt = dealt.repartition(*CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(cells_linked(percent), "a long, b long").distinct()


def linked_components(members: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(node, component) of all links between members of common buckets; nodes without a link are left out.

    First every member of a bucket is held against the bucket's least member:
    one pair each, however large the bucket, and most groups of near copies are
    one component then.  In buckets that still hold several components all
    other pairs are compared in blocks.  A pair of a bucket is left out only if
    both are in one component already.
    """
    least = members.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = materialise(members.join(materialise(least), "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct())
    components = materialise(connected_components(verified(pairs, sets, percent)))
    more = materialise(bucket_links(members, components, sets, percent))
    if more.isEmpty():
        return components
    joined = materialise(connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("whole")))
    known = components.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(components, "node", "left_anti")
    return known.unionByName(alone)


def near_duplicates(
    docs: DataFrame, percent: int = SIMILARITY, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Classes of documents linked by 100 * common >= percent * united shingles.

    Documents of equal sets are one node, so copies cost no pairs; a key that
    stands with several texts is in a node for each.  Nodes that share a
    band key (``BINS`` / ``BAND_ROWS`` bands; a pair at 0.75 has none in common once
    in 190,000) are candidates, and full sets confirm them.

    Returns key, n_shingles, component_id (the least key of the class), kept
    (whether the row has that key) and the columns named in ``carry``.  Null and
    empty texts, or ones without words, have an empty set and are classes of
    their own.  Rows that repeat a key with the same text share its answer; with
    different texts each has its own.  A null key is linked like others but
    never names a class that has another key.
    """
    there, _, back = carried(docs, carry)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *there)
    made = materialise(sketched(rows))
    worded = made.where("n > 0")
    digest = ["d1", "d2", "n"]
    # written once, so that the numbers of the nodes stay as they are
    classes = materialise(
        worded.groupBy(*digest).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    buckets = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("bucket")
    members = materialise(buckets.join(materialise(shared), "bucket", "left_semi"))
    nodes = members.select("node").distinct()
    wanted = materialise(classes.join(materialise(nodes), "node", "left_semi").select("node", *digest, "rep"))
    reps = materialise(wanted.select("rep").distinct())
    texts = rows.select("id", "text").join(reps, F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    sets = materialise(full_sets(texts).dropDuplicates(digest).join(wanted, digest).select("node", "shingles", "sketch"))
    linked = linked_components(members, sets, percent).join(wanted, "node").select("component", *digest, "rep")
    linked = materialise(linked)
    names = linked.groupBy("component").agg(F.min("rep").alias("name"))
    named = (
        linked.join(materialise(names), "component").select(*digest, "name")
        .unionByName(classes.where("copies > 1").select(*digest, F.col("rep").alias("name")))
        .groupBy(*digest).agg(F.min("name").alias("name"))
    )
    answer = worded.drop("bands").join(materialise(named), digest, "left").withColumn("name", F.coalesce("name", "id"))
    alone = made.where("n = 0").drop("bands").withColumn("name", F.col("id"))
    return answer.unionByName(alone).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"),
        F.col("id").eqNullSafe(F.col("name")).alias("kept"), *back,
    )
