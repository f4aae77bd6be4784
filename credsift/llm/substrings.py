"""Substring dedup: repeated word windows found by doubling their length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.llm.words import Words, carried, parts, rolling, words_of
from credsift.session import materialise, table_folder

WINDOW = 50
PLACE_BITS = np.uint64(28)
EVERYTHING = 2**31 - 1


def window_seeds(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first start, last start) of half-length windows that stand for whole ones.

    Among the half-length windows inside a window, the one of the least hash,
    leftmost of equal ones, stands for it.  Equal windows have equal seeds, and
    one seed stands for a run of starts.
    """
    half, n = window // 2, len(words.hashes)
    inner = window - half + 1
    ends = np.repeat(words.offsets[1:], np.diff(words.offsets))
    starts = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(n - half + 1)
    hashes = rolling(words.hashes, at, at + half)
    least = (hashes >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    span = 1
    while span < inner:
        step = min(span, inner - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    chosen = (least[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    row = np.searchsorted(words.offsets, chosen[first], side="right") - 1
    base = words.offsets[row]
    return hashes[chosen[first]], row, starts[first] - base, starts[last] - base


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.minimum(starts, size), 1)
    np.add.at(steps, np.minimum(ends, size), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_seeds(rows: DataFrame, window: int) -> DataFrame:
    """(id, tag, first, last): runs of window starts whose seed stands in two rows of different ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                seed, row, first, last = window_seeds(words_of(part.column("text")), window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), part.column("id").take(pa.array(row)), part.column("tag").take(pa.array(row)),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    ["seed", "id", "tag", "first", "last"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    seeds = materialise(
        rows.where("id is not null").mapInArrow(run, f"seed long, id {kind}, tag long, first int, last int")
    )
    twice = seeds.groupBy("seed").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x != y").select("seed")
    return seeds.join(materialise(twice), "seed", "left_semi").select("id", "tag", "first", "last")


def repeated_windows(store: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(id, tag, start): windows that also start in a row of a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                words = words_of(part.column("text"))
                runs = part.column("runs")
                per_row = np.diff(runs.offsets.to_numpy())
                flat = runs.flatten()
                base = words.offsets[:-1].repeat(per_row)
                first = flat.field("first").to_numpy() + base
                last = flat.field("last").to_numpy() + base
                starts = np.flatnonzero(covered(len(words.hashes), first, last + 1))
                row = np.searchsorted(words.offsets, starts, side="right") - 1
                h1, h2 = (rolling(words.hashes, starts, starts + window, name) for name in (7, 8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     part.column("id").take(pa.array(row)), part.column("tag").take(pa.array(row)),
                     pa.array((starts - words.offsets[row]).astype(np.int32))],
                    ["h1", "h2", "id", "tag", "start"],
                )

    kind = store.schema["id"].dataType.simpleString()
    windows = materialise(
        store.join(runs, ["id", "tag"]).select("id", "tag", "text", "runs")
        .mapInArrow(run, f"h1 long, h2 int, id {kind}, tag long, start int")
    )
    source = windows.groupBy("h1", "h2").agg(F.min("id").alias("source"), F.max("id").alias("top")).where("source != top")
    source = materialise(source.select("h1", "h2", "source"))
    return windows.join(source, ["h1", "h2"]).where("id > source").select("id", "tag", "start")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Removes every word covered by a window that also starts in a document of a smaller key.

    Two levels.  Windows of half the length, thinned out so that every whole
    window keeps one that stands for it, are held against each other over all
    rows; only where one repeats are windows of twice that length hashed (96
    bits) and held against each other.  So unique text costs one seed per
    thirteen words and whole windows are shuffled for repeated text alone.  Rows
    with the text of a row of a smaller key are removed whole and skip level two.

    The texts are laid out by key once, in the shared folder, and both later
    passes read them from there without another shuffle.

    Returns key, n_words, n_removed, kept (the words left, joined by a blank),
    original (the text as it was) and the columns of ``carry``.
    Null is a text without words.  Rows that repeat a key do not remove each
    other's words; a null key is neither smaller nor larger than others, so
    such a row stays whole and removes nothing.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    there, schema, back = carried(docs, carry)
    rows = docs.select(
        F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tag"), F.xxhash64(F.lit(1), F.col(text)).alias("twin"),
        F.col(text).alias("text"), *there,
    )
    name = f"texts_{uuid4().hex}"
    (
        rows.repartition(n_parts, "id", "tag").write.bucketBy(n_parts, "id", "tag")
        .option("path", table_folder(spark, "texts", name)).option("compression", "zstd").saveAsTable(name)
    )
    store = spark.table(name)

    same = store.groupBy("tag", "twin").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x != y")
    copies = materialise(
        store.select("id", "tag", "twin").join(materialise(same.select("tag", "twin", "x")), ["tag", "twin"])
        .where("id > x").select("id", "tag").distinct()
    )
    runs = (
        repeated_seeds(store, window).groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
        .join(copies, ["id", "tag"], "left_anti")
    )
    starts = repeated_windows(store, runs, window).groupBy("id", "tag").agg(F.collect_list("start").alias("starts"))
    removed = starts.select("id", "tag", "starts", F.lit(window).alias("span")).unionByName(
        copies.select("id", "tag", F.array(F.lit(0)).alias("starts"), F.lit(EVERYTHING).alias("span"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                n_words, n_removed, kept = [], [], []
                for raw, starts, span in zip(
                    part.column("text").cast(pa.binary()).to_pylist(), part.column("starts"), part.column("span").to_pylist()
                ):
                    words = raw.split() if raw else []
                    n_words.append(len(words))
                    if span is not None and len(words) >= window:
                        first = starts.values.to_numpy().astype(np.int64)
                        out = covered(len(words), first, first + span)
                        words = [w for w, gone in zip(words, out.tolist()) if not gone]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), part.column("text"), *part.columns[4:]],
                    ["id", "n_words", "n_removed", "kept", "text", *part.schema.names[4:]],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return (
        store.drop("twin").join(removed, ["id", "tag"], "left")
        .select("id", "text", "starts", "span", *[c for c in store.columns if c.startswith("carried_")])
        .mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept binary, text string{schema}")
        .select(F.col("id").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), F.col("text").alias("original"), *back)
    )
