import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from credsift.operators.rates import anchored_window_count, rate_limit_flags
from credsift.streaming.rates import rate_limit_stream

T0 = datetime(2026, 1, 1)


def log(spark, rows, kind="timestamp_ntz"):
    """Events from (key, second) pairs."""
    data = [(k, i, T0 + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)]
    return spark.createDataFrame(data, f"ip string, id long, ts {kind}")


def brute_force(rows, window, limit):
    out, state = {}, {}
    for s, i, k in sorted((s, i, k) for i, (k, s) in enumerate(rows)):
        start, n = state.get(k, (None, 0))
        start, n = (s, 1) if start is None or s - start > window else (start, n + 1)
        state[k] = (start, n)
        out[i] = (T0 + timedelta(seconds=start), n, n == 1 or n <= limit)
    return out


def count(df, window, limit, **kwargs):
    rows = anchored_window_count(df, "ip", "ts", window, limit, ["id"], **kwargs).collect()
    return {r.id: (r.window_start, r.n, r.allowed) for r in rows}


def flags(spark, rows, window, limit):
    df = rate_limit_flags(log(spark, rows), "ip", "ts", window, limit, ["id"])
    return [r.allowed for r in df.orderBy("id").collect()]


def test_limits(spark):
    assert flags(spark, [("a", 0), ("a", 1), ("a", 2)], 60, 3) == [True] * 3
    assert flags(spark, [("a", 0), ("a", 1), ("a", 2), ("a", 3)], 60, 3) == [True] * 3 + [False]
    assert flags(spark, [("a", 0)] * 4 + [("b", 1)], 60, 3) == [True] * 3 + [False, True]
    # exactly one window later still counts into it
    assert flags(spark, [("a", 0), ("a", 0.5), ("a", 1), ("a", 1.1)], 1, 2) == [True, True, False, True]
    assert flags(spark, [("a", 0), ("a", 1), ("a", 100)], 60, 0) == [True, False, True]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket_windows", [1, 2, 7, 256])
def test_against_one_event_after_the_other(spark, seed, bucket_windows):
    rng = random.Random(seed)
    # one hot key, keys with gaps of many buckets, events at the same time
    rows = [("hot", rng.randrange(4000) / 4) for _ in range(1500)]
    rows += [(f"k{rng.randrange(5)}", rng.randrange(100) * 37) for _ in range(300)]
    rows += [("even", 3 * i) for i in range(300)] + [("old", -rng.randrange(5000)) for _ in range(100)]
    assert count(log(spark, rows), 10, 4, bucket_windows=bucket_windows) == brute_force(rows, 10, 4)


def test_other_columns_stay(spark):
    df = log(spark, [("a", 0), ("a", 1)], "timestamp").withColumn(
        "payload", F.when(F.col("id") == 0, F.lit(7)).cast("int")
    )
    out = anchored_window_count(df, "ip", "ts", 60, 1, ["id"])
    assert out.columns == [*df.columns, "window_start", "n", "allowed"]
    assert out.schema["payload"].dataType.typeName() == "integer"
    assert [(r.payload, r.allowed, r.window_start) for r in out.orderBy("id").collect()] == [
        (7, True, T0), (None, False, T0)
    ]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(4)}", s) for s in sorted(rng.randrange(600) for _ in range(400))]
    df = log(spark, rows, "timestamp")
    source = str(tmp_path / "in")
    for lo in range(0, 400, 100):
        df.where((F.col("id") >= lo) & (F.col("id") < lo + 100)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    out, log_dir = str(tmp_path / "out"), str(tmp_path / "log")
    flagged = rate_limit_stream(stream, "ip", "ts", "id", 30, 3)
    (flagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", log_dir)
     .trigger(availableNow=True).start().awaitTermination())
    got = {r.id: (r.window_start, r.n, r.allowed) for r in spark.read.parquet(out).collect()}
    assert got == brute_force(rows, 30, 3)


def test_events_without_key_or_time(spark):
    rows = [("a", 5), (None, 5), ("a", None), ("a", 6), (None, None), (None, 7)]
    df = spark.createDataFrame(rows, "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = anchored_window_count(df, "k", "ts", 60, 1).collect()
    assert sorted((r.k, r.s, r.n, r.allowed) for r in got if r.k and r.s) == [("a", 5, 1, True), ("a", 6, 2, False)]
    rest = [r for r in got if not (r.k and r.s)]
    assert len(rest) == 4 and all(r.n is None and r.window_start is None and r.allowed for r in rest)


def test_state_expires(spark, tmp_path):
    """A key is forgotten once nothing of it has arrived for as long as asked: its count starts again."""
    source, out, log_dir = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "ip string, id long, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame([(k, i, T0) for k, i in rows], schema).coalesce(1).write.mode("append").parquet(source)
        flagged = rate_limit_stream(spark.readStream.schema(schema).parquet(source), "ip", "ts", "id", 1, 2, forget_after_seconds=1)
        (flagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", log_dir)
         .trigger(availableNow=True).start().awaitTermination())

    arrive(("a", 1), ("a", 2), ("a", 3))
    arrive(("a", 4))  # still known: the window it opened goes on
    for i in (10, 11):  # time passes with other keys only
        time.sleep(2)
        arrive(("b", i))
    arrive(("a", 5))
    got = {r.id: (r.n, r.allowed) for r in spark.read.parquet(out).where("ip = 'a'").collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (4, False), 5: (1, True)}


def test_files_out_of_time_order(spark, tmp_path):
    """Later files with earlier events: they count into the window that is open, and none is lost."""
    df = log(spark, [("a", 100), ("a", 101), ("a", 40), ("a", 90), ("a", 170)], "timestamp")
    source = str(tmp_path / "in")
    for ids in ((0, 1), (2, 3), (4,)):
        df.where(F.col("id").isin(*ids)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    (rate_limit_stream(stream, "ip", "ts", "id", 60, 3).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination())
    got = {r.id: (r.window_start, r.n, r.allowed) for r in spark.read.parquet(out).collect()}
    opened, again = T0 + timedelta(seconds=100), T0 + timedelta(seconds=170)
    assert got == {
        0: (opened, 1, True), 1: (opened, 2, True), 2: (opened, 3, True), 3: (opened, 4, False), 4: (again, 1, True)
    }
