"""Anchored windows over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from credsift.operators.rates import micros


def rate_limit_stream(
    df: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    window_seconds: int = 60,
    limit: int = 5,
    forget_after_seconds: int = 86_400,
) -> DataFrame:
    """``key, event_id, window_start, n, allowed`` for each event of a stream.

    Within a micro-batch events are taken by time and id.  No event is too
    late: one from before the open window counts into it.  A key is forgotten
    when no event of it has arrived for the width of its window, and for
    ``forget_after_seconds`` at least, by the clock of the job.  An event without
    a key or a time comes out with no window and is allowed.
    """
    width = window_seconds * 1_000_000
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    # the watermark is on the time of arrival, which is never behind it
    events = (
        df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")
        .select(key, event_id, micros(df, ts).alias("_us"), "_arrived", F.unix_millis("_arrived").alias("_at"))
    )
    keep_ms = max(window_seconds, forget_after_seconds) * 1000
    output = T.StructType([
        df.schema[key], df.schema[event_id],
        T.StructField("_start", T.LongType()), T.StructField("n", T.LongType()),
    ])
    state_type = T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])

    def count(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["_us", event_id])
        arrived = int(rows["_at"].max())
        if group[0] is None:  # no key, no window
            none = [None] * len(rows)
            yield pd.DataFrame({key: none, event_id: rows[event_id].to_numpy(), "_start": none, "n": none})
            return
        untimed = rows[rows["_us"].isna()]
        if len(untimed):
            none = [None] * len(untimed)
            yield pd.DataFrame({key: group[0], event_id: untimed[event_id].to_numpy(), "_start": none, "n": none})
            rows = rows[rows["_us"].notna()]
        start, n = state.get if state.exists else (None, 0)
        starts, counts = [], []
        for us in rows["_us"].astype("int64").tolist():
            if start is None or us - start > width:
                start, n = us, 1
            else:
                n += 1
            starts.append(start)
            counts.append(n)
        if start is None:
            return
        state.update((start, n))
        state.setTimeoutTimestamp(arrived + keep_ms)
        yield pd.DataFrame({key: group[0], event_id: rows[event_id].to_numpy(), "_start": starts, "n": counts})

    counted = events.groupBy(key).applyInPandasWithState(
        count, output, state_type, "append", GroupStateTimeout.EventTimeTimeout
    )
    return counted.select(
        key, event_id, F.timestamp_micros("_start").alias("window_start"), "n",
        F.coalesce((F.col("n") == 1) | (F.col("n") <= limit), F.lit(True)).alias("allowed"),
    )
