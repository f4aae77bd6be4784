"""Ranks of groups that are spread over many tasks."""

import random

from pyspark.sql import functions as F

from credsift.operators.ranks import ranked


def test_ranks_across_ranges(spark):
    rng = random.Random(1)
    rows = [("hot", None, i) for i in range(900)] + [(rng.choice(["a", "b", None]), rng.choice(["x", None]), i) for i in range(100)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, j string, v int")
        out = ranked(df, ["k", "j"], [F.col("v").desc()], "rank")
        got = sorted((tuple(r) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for k, j, v in rows:
        groups.setdefault((k, j), []).append(v)
    want = [(*key, v, n) for key, vs in groups.items() for n, v in enumerate(sorted(vs, reverse=True), 1)]
    assert got == sorted(want, key=repr)


def test_no_rows(spark):
    assert ranked(spark.createDataFrame([], "k string, v int"), ["k"], [F.col("v").asc()], "rank").count() == 0
