"""Anchored windows: counting events per key in windows that open at an event.

A window opens at the first event of a key and again at the first event more
than ``window`` after the last opening.  Where a window starts depends on all
windows before it, so neither time windows nor session windows express it.

A key may hold a large part of all events, so its timeline is cut into buckets
of ``bucket_windows`` windows that are worked on separately:

1. each bucket is summed up as a function from the window that is open when the
   bucket begins to the window that is open when it ends.  Chains of windows
   that start at different events soon meet, so the function is a short list;
2. the functions of a key are applied one after the other, which gives the open
   window at the start of each bucket;
3. with that, each bucket labels its events in one pass.

Each step streams over sorted rows.  The largest state is the list of step 1,
bounded by the events in the first window of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(df: DataFrame, ts: str) -> Column:
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{ts}`)")
    return F.unix_micros(F.col(ts))


def from_micros(df: DataFrame, ts: str, value: str) -> Column:
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"{_EPOCH_NTZ} + make_dt_interval(0, 0, 0, cast(`{value}` / 1000000 AS decimal(18, 6)))")
    return F.timestamp_micros(F.col(value))


def anchored_window_count(
    df: DataFrame,
    key: str,
    ts: str,
    window_seconds: int,
    limit: int,
    tiebreak: Sequence[str] = (),
    bucket_windows: int = 256,
) -> DataFrame:
    """``df`` with ``window_start``, the running count ``n`` in the window, and ``allowed``.

    Events of equal time are taken in ``tiebreak`` order.  Refused events count
    too; the first event of a window always passes.  An event without a key or
    a time stands in no window and passes.
    """
    whole = F.col(key).isNotNull() & F.col(ts).isNotNull()
    counted = _counted(df.where(whole), key, ts, window_seconds, limit, tiebreak, bucket_windows)
    kinds = {f.name: f.dataType for f in counted.schema}
    rest = df.where(~whole).select(
        *df.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in ("window_start", "n")], F.lit(True).alias("allowed")
    )
    return counted.unionByName(rest)


def _counted(
    df: DataFrame, key: str, ts: str, window_seconds: int, limit: int, tiebreak: Sequence[str], bucket_windows: int
) -> DataFrame:
    width = window_seconds * 1_000_000
    span = width * bucket_windows
    bucket = F.expr(f"_us div {span}L - if(_us % {span}L < 0, 1, 0)").cast("long")
    events = df.withColumn("_us", micros(df, ts).cast("long")).withColumn("_bucket", bucket)
    key_type = df.schema[key].dataType

    slim = events.select(F.col(key).alias("key"), F.col("_bucket").alias("bucket"), F.col("_us").alias("us"))
    by_bucket = slim.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "us")
    functions = by_bucket.mapInArrow(
        _bucket_functions(width, bucket_windows),
        T.StructType([T.StructField("key", key_type)] + [
            T.StructField(name, T.LongType())
            for name in ("bucket", "upto", "exit_start", "exit_count", "first_us", "events")
        ]),
    )
    states = functions.repartition("key").sortWithinPartitions("key", "bucket", "upto").mapInArrow(
        _open_windows(width),
        T.StructType([T.StructField("key", key_type)] + [
            T.StructField(name, T.LongType()) for name in ("bucket", "start", "count")
        ]),
    )

    # The state of a bucket travels as a row that sorts before its events.
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != key]
    markers = states.select(
        F.col("key").alias(key), *nothing, F.lit(None).cast("long").alias("_us"), F.col("bucket").alias("_bucket"),
        F.col("start").alias("_start"), F.col("count").alias("_n"),
    )
    null = F.lit(None).cast("long")
    together = events.withColumn("_start", null).withColumn("_n", null).unionByName(markers)
    labelled = (
        together.repartition(key, "_bucket")
        .sortWithinPartitions(key, "_bucket", F.col("_us").asc_nulls_first(), *tiebreak)
        .mapInArrow(_label(key, width), together.schema)
    )
    return labelled.select(
        *df.columns,
        from_micros(df, ts, "_start").alias("window_start"),
        F.col("_n").alias("n"),
        ((F.col("_n") == 1) | (F.col("_n") <= limit)).alias("allowed"),
    )


def rate_limit_flags(
    df: DataFrame, key: str, ts: str, window_seconds: int = 60, limit: int = 5, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Only whether each event passes."""
    return anchored_window_count(df, key, ts, window_seconds, limit, tiebreak).drop("window_start", "n")


def _next_openings(us: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """For each event, the first one of its group that a window opened by it does not hold; the number of events if none.

    Events are in order of group and time.
    """
    ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, len(us)] if len(us) else np.zeros(0, np.int64)
    out = np.empty(len(us), np.int64)
    start = 0
    # times count from a group's first event, so that groups can be laid out one behind the other
    first = us[np.r_[0, ends[:-1]]] if len(us) else us
    span = int((us[ends - 1] - first).max()) + width + 1 if len(us) else 1
    at_once = max(1, (1 << 62) // span)
    for lo in range(0, len(ends), at_once):
        hi = min(len(ends), lo + at_once)
        stop = int(ends[hi - 1])
        numbers = group[start:stop] - group[start]
        line = us[start:stop] - first[group[start:stop]] + numbers * span
        out[start:stop] = start + np.searchsorted(line, line + width, side="right")
        start = stop
    return np.where(out < ends[group], out, len(us)) if len(us) else out


def _groups(batch: pa.RecordBatch, before: pa.RecordBatch | None, names: Sequence[str]) -> tuple[np.ndarray, bool]:
    """The number of each row's group, and whether the first one is that of the last row before."""
    new = np.ones(len(batch), bool)
    if len(batch) > 1:
        new[1:] = False
        for name in names:
            column = batch.column(name)
            new[1:] |= ~_same(column.slice(1), column.slice(0, len(column) - 1))
    goes_on = before is not None and all(_same(batch.column(n).slice(0, 1), before.column(n))[0] for n in names)
    return np.cumsum(new) - 1, goes_on


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


_FUNCTION = ("key", "bucket", "upto", "exit_start", "exit_count", "first_us", "events")


def _bucket_functions(width: int, bucket_windows: int) -> Callable[[Batches], Batches]:
    """Chains of windows that start at different events meet; only where they end matters.

    Of the beginnings that end in the same window the last is kept.  What goes
    on from one batch to the next is, for the bucket they share, the list of
    beginnings with the window that each has open.
    """
    span = width * bucket_windows

    def run(batches: Batches) -> Batches:
        held: _Open | None = None
        for batch in batches:
            if not len(batch):
                continue
            us = batch.column("us").to_numpy(zero_copy_only=False)
            group, goes_on = _groups(batch, held.row if held else None, ("key", "bucket"))
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(us)])
            following = _next_openings(us, group, width)
            last = np.where(following < len(us), following, np.arange(len(us)))
            while True:  # the window that a chain has open at the end, by doubling
                further = last[last]
                if (further == last).all():
                    break
                last = further
            done = []
            if held is not None and not goes_on:
                done.append(held.result())
                held = None
            offset = np.where(group == 0, held.events, 0) if held else np.zeros(len(us), np.int64)
            number = np.arange(len(us)) - starts[group] + offset
            # a window may open at the first events, whatever was open before the bucket, and at the one behind them
            early = us - batch.column("bucket").to_numpy(zero_copy_only=False) * span <= width
            distinct = np.r_[True, (us[1:] != us[:-1]) | (group[1:] != group[:-1])]
            late = ~early & np.r_[True, early[:-1] | (group[1:] != group[:-1])]
            if held:
                distinct[0] &= us[0] != held.last_us
                late[0] &= not held.late
            begins = np.flatnonzero((early | late) & distinct)
            of = group[begins]
            for g in range(len(starts)) if len(starts) < 2 else (0, len(starts) - 1):
                mine = begins[of == g]
                chain = _Open.chains(us[mine], us[last[mine]], number[last[mine]])
                lo, hi = int(starts[g]), int(starts[g] + sizes[g])
                if g == 0 and held:
                    held.extend(us[lo:hi], last[lo:hi], number, us, width, lo, chain)
                else:
                    opened = _Open(batch.slice(lo, 1).select(["key", "bucket"]), int(us[lo]), chain, hi - lo)
                    if g == len(starts) - 1:
                        if held:
                            done.append(held.result())
                        held = opened
                    else:
                        done.append(opened.result())
                        continue
                held.last_us, held.late = int(us[hi - 1]), bool(held.late or not early[hi - 1])
            inner = begins[(of > 0) & (of < len(starts) - 1)]
            if len(inner):
                of = group[inner]
                keep = np.r_[(of[1:] != of[:-1]) | (last[inner[1:]] != last[inner[:-1]]), True]
                inner, of = inner[keep], of[keep]
                rows = batch.select(["key", "bucket"]).take(pa.array(starts[of]))
                done.append(_function_rows(
                    rows, us[inner], us[last[inner]], sizes[of] - number[last[inner]], us[starts[of]], sizes[of]
                ))
            for out in done:
                yield out
        if held is not None:
            yield held.result()

    return run


def _function_rows(rows: pa.RecordBatch, upto, exit_start, exit_count, first, events) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c, np.int64)) for c in (upto, exit_start, exit_count, first, events)]
    return pa.RecordBatch.from_arrays([*rows.columns, *columns], names=list(_FUNCTION))


class _Open:
    """A bucket whose events have not all been seen: beginnings, with the start and number of the window each has open."""

    def __init__(self, row: pa.RecordBatch, first_us: int, chains: tuple[np.ndarray, ...], events: int) -> None:
        self.row, self.first_us, self.events = row, first_us, events
        self.upto, self.start, self.number = chains
        self.last_us, self.late = first_us, False

    @staticmethod
    def chains(upto: np.ndarray, start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the beginnings with the same open window the last one."""
        keep = np.r_[number[1:] != number[:-1], True] if len(number) else np.zeros(0, bool)
        return upto[keep], start[keep], number[keep]

    def extend(self, us, last, number, all_us, width, lo, more) -> None:
        """More events of the bucket: open windows end where a later one opens."""
        at = np.searchsorted(us, self.start + width, side="right")
        ends = at < len(us)
        goal = last[at[ends]]
        start, new_number = self.start.copy(), self.number.copy()
        start[ends], new_number[ends] = all_us[goal], number[goal]
        both = [np.concatenate(x) for x in zip((self.upto, start, new_number), more)]
        self.upto, self.start, self.number = self.chains(*both)
        self.events += len(us)

    def result(self) -> pa.RecordBatch:
        rows = self.row.take(pa.array(np.zeros(len(self.upto), np.int64)))
        n = np.full(len(self.upto), self.events)
        return _function_rows(rows, self.upto, self.start, self.events - self.number, np.full(len(n), self.first_us), n)


def _open_windows(width: int) -> Callable[[Batches], Batches]:
    names = ("key", "bucket", "upto", "exit_start", "exit_count", "first_us", "events")

    def run(batches: Batches) -> Batches:
        key = bucket = start = count = after = None
        size = 0
        for batch in batches:
            out: list[tuple] = []
            for k, b, upto, exit_start, exit_count, first, events in zip(
                *(batch.column(c).to_pylist() for c in names)
            ):
                if (k, b) != (key, bucket):
                    if k != key:
                        start = count = None
                    elif after is not None:
                        start, count = after
                    else:
                        # no window opened in the bucket: all of it fell into the open one
                        count += size
                    key, bucket, after, size = k, b, None, events
                    if start is not None and first - start <= width:
                        out.append((k, b, start, count))
                if after is None and (start is None or upto - start > width):
                    after = (exit_start, exit_count)
            if out:
                types = (batch.schema.field("key").type, *[pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "bucket", "start", "count"]
                )

    return run


def _label(key: str, width: int) -> Callable[[Batches], Batches]:
    """Start and running count of each event's window; rows without a time hand over the window that is open."""

    def run(batches: Batches) -> Batches:
        row = None
        start = count = None  # the window that the last group has open
        for batch in batches:
            if not len(batch):
                continue
            group, goes_on = _groups(batch, row, (key, "_bucket"))
            is_event = np.asarray(pc.is_valid(batch.column("_us")))
            open_start, open_count = (np.asarray(pc.fill_null(batch.column(c), 0)) for c in ("_start", "_n"))
            groups = int(group[-1]) + 1
            # per group: whether a window is open at its first event here, since when, and how many events it holds
            opened, since, held = np.zeros(groups, bool), np.zeros(groups, np.int64), np.zeros(groups, np.int64)
            if goes_on and start is not None:
                opened[0], since[0], held[0] = True, start, count
            marks = np.flatnonzero(~is_event)
            opened[group[marks]], since[group[marks]], held[group[marks]] = True, open_start[marks], open_count[marks]
            events = batch.filter(pa.array(is_event))
            group = group[is_event]
            us = np.asarray(pc.fill_null(events.column("_us"), 0))
            starts, counts = _windows(us, group, opened, since, held, width)
            last = groups - 1
            if len(group) and group[-1] == last:
                start, count = int(starts[-1]), int(counts[-1])
            else:
                start, count = (int(since[last]), int(held[last])) if opened[last] else (None, None)
            row = batch.slice(len(batch) - 1, 1)
            columns = [
                pa.array(starts) if f.name == "_start" else pa.array(counts) if f.name == "_n" else events.column(f.name)
                for f in batch.schema
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _windows(
    us: np.ndarray, group: np.ndarray, opened: np.ndarray, since: np.ndarray, held: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Start of each event's window and the event's number in it; events are in order of group and time."""
    n = len(us)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(n)
    _, dense = np.unique(group, return_inverse=True)
    following = _next_openings(us, dense, width)
    inside = opened[group] & (us - since[group] <= width)
    # the first event of each group that the window open before does not hold
    first = np.r_[True, group[1:] != group[:-1]]
    opens = ~inside & (first | np.r_[False, inside[:-1]])
    front = np.flatnonzero(opens)
    while len(front := following[front][following[front] < n]):  # all groups take a step at a time
        opens[front] = True
    at = np.maximum.accumulate(np.where(opens, place, -1))
    group_start = np.maximum.accumulate(np.where(first, place, 0))
    carried = at < group_start
    starts = np.where(carried, since[group], us[np.maximum(at, 0)])
    counts = np.where(carried, held[group] + place - group_start + 1, place - at + 1)
    return starts, counts
