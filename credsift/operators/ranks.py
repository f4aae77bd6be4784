"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.session import materialise


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place from 1 of each row in its group of equal ``keys`` by ``order``.

    Rows are dealt to tasks by ranges of keys and order, so a large group is
    spread over many; each task counts its own rows, and what a group has in
    the ranges before is added.  For that, two rows per range come to the
    driver.  Rows that are equal in keys and order should be equal in all.
    """
    by = [*(F.col(k).asc() for k in keys), *order]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, at, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                column = batch.column(k)
                before = pa.concat_arrays([column.slice(0, 1) if last is None else last.column(k), column.slice(0, len(batch) - 1)])
                same = pc.or_(pc.fill_null(pc.equal(column, before), False), pc.and_(pc.is_null(column), pc.is_null(before)))
                new |= ~same.to_numpy(zero_copy_only=False)
            new[0] |= last is None
            places = np.arange(len(batch))
            starts = np.maximum.accumulate(np.where(new, places, -1))
            ranks = np.where(starts < 0, seen + places + 1, places - starts + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(at + places), pa.array(ranks)],
                names=[*batch.schema.names, "_part", "_at", name],
            )
            seen, at, last = int(ranks[-1]), at + len(batch), batch.slice(len(batch) - 1, 1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    counted = materialise(
        df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, f"{kinds}, _part int, _at long, `{name}` long")
    )
    key = F.struct(*keys)
    edges = counted.groupBy("_part").agg(
        F.min_by(key, "_at").alias("head"), F.max_by(key, "_at").alias("tail"), F.max_by(name, "_at").alias("n")
    ).orderBy("_part").collect()
    rows, tail, total = [], None, 0
    for e in edges:
        goes_on = tail is not None and e["head"] == tail
        if goes_on:
            rows.append((e["_part"], total, e["head"]))
        total = e["n"] + (total if goes_on and e["tail"] == e["head"] else 0)
        tail = e["tail"]
    plain = counted.drop("_part", "_at")
    if not rows:
        return plain
    kind = counted.select(key.alias("k")).schema["k"].dataType.simpleString()
    before = df.sparkSession.createDataFrame(rows, f"_part int, _before long, _head {kind}")
    met = counted.join(F.broadcast(before), "_part", "left")
    more = F.when(key.eqNullSafe(F.col("_head")), F.col("_before")).otherwise(0)
    return met.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0))).select(*plain.columns)
