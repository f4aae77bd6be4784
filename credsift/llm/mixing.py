"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsift.llm.words import carried
from credsift.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one range of shuffled or virtual time holds on average.
ROWS_PER_RANGE = 4096
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """(source, source_size) to (source, source_rank, source_size, target).

    Sources in code point order, null last, weigh ``weights`` over and over.
    With the sources in order of capacity per weight, those that fill up come
    first, so one running sum finds the level the others share by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("source_rank", F.row_number().over(order) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("room", F.col("source_size") * F.lit(max_repeats))
    )
    everything = Window.partitionBy(F.lit(0))
    filling = Window.orderBy(F.col("room") / F.col("weight"), "source_rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("room").over(before), F.lit(0))
    ) / F.sum("weight").over(from_here)
    full = F.col("room") <= F.col("level") * F.col("weight")
    return (
        ranked.withColumn("level", level)
        .withColumn("shared", F.max(F.when(~full, F.col("level"))).over(everything))
        .select(
            "source", "source_rank", "source_size",
            F.least(F.col("room").cast("double"), F.coalesce(F.col("shared") * F.col("weight"), F.col("room"))).alias("target"),
        )
    )


def mix_sources(
    docs: DataFrame, size: Column, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
    max_repeats: int = 2, seed: str = "mix", key: str = "doc_id", source: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often each row of ``docs`` goes into the mix.

    The rows of a source are shuffled by a hash of their key.  Pass ``e`` over a
    source gives a row the virtual finish time (e * source size + running size) /
    target of the source; all rows of all passes in order of that time, cut where
    their sizes reach the budget (``share`` of all sizes), are the mix.

    Running sizes are sums over ranges of the hash plus a window inside each
    range; only the range of virtual time in which the budget ends is sorted.
    So no source, however large, is one task's work.

    Returns one row per row of ``docs``: key, size, source_size, target, taken
    (size times copies), copies and the columns named in ``carry``.  Rows of size 0 are never copied.  Null keys,
    null sources and repeated rows are rows like others; an empty table gives
    an empty one; equal input gives equal output.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    there, _, back = carried(docs, carry)
    along = [f"carried_{i}" for i in range(len(carry))]
    rows = materialise(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), size.cast("long").alias("size"),
            F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"), *there,
        )
    )
    targets = materialise(
        source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    )
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(1, (n_rows // ROWS_PER_RANGE).bit_length())
    rows = rows.withColumn("range", F.shiftright("hash", HASH_BITS - bits)).alias("r").join(
        targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))
    ).select("key", "source_rank", "source_size", "target", "size", "hash", "range", *along)

    earlier = Window.partitionBy("source_rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source_rank", "range").agg(F.sum("size").alias("range_size")).select(
        "source_rank", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source_rank", "range").orderBy("hash", "key", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    queued = materialise(
        rows.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["source_rank", "range"])
        .withColumn("running", F.col("offset") + F.col("inside"))
    )

    n_ranges = 1 << bits
    finish = [
        F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("source_size") * F.lit(e) + F.col("running")) / F.col("target"))
        for e in range(max_repeats)
    ]
    place = [F.struct(f.alias("finish"), "source_rank", "hash", "key", "size", F.lit(e).alias("pass")) for e, f in enumerate(finish)]
    items = queued.select(F.explode(F.array(*place)).alias("item")).where("item.finish is not null").withColumn(
        "slot", F.floor(F.least(F.col("item.finish"), F.lit(2.0)) * n_ranges)
    )
    so_far = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_slot = (
        items.groupBy("slot").agg(F.sum("item.size").alias("slot_size")).withColumn("upto", F.sum("slot_size").over(so_far))
        .where(F.col("upto") > F.lit(total * float(share))).orderBy("slot").select("slot", (F.col("upto") - F.col("slot_size")).alias("before")).first()
    )
    if cut_slot is None:
        copied = [f.isNotNull() for f in finish]
    else:
        in_order = Window.partitionBy("slot").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = (
            items.where(F.col("slot") == cut_slot["slot"]).withColumn("upto", F.sum("item.size").over(in_order) + F.lit(cut_slot["before"]))
            .where(F.col("upto") > F.lit(total * float(share))).agg(F.min("item").alias("first_left_out"))
        )
        edge = cut.first()["first_left_out"]
        bound = F.struct(
            F.lit(float(edge["finish"])).alias("finish"), F.lit(edge["source_rank"]).cast("int").alias("source_rank"),
            F.lit(edge["hash"]).cast("long").alias("hash"), F.lit(edge["key"]).cast(rows.schema["key"].dataType).alias("key"),
            F.lit(edge["size"]).cast("long").alias("size"), F.lit(edge["pass"]).cast("int").alias("pass"),
        )
        copied = [f.isNotNull() & (p < bound) for f, p in zip(finish, place)]
    copies = sum((F.when(c, 1).otherwise(0) for c in copied), F.lit(0))
    return queued.withColumn("copies", copies.cast("int")).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *back
    )
