"""Joins of rows that may lie together by less than the keys of the join.

Spark deals both sides of a join by all of its keys, also if a part of them has
brought equal rows together before.  A window asks for no more than that, so
columns of one table are handed to the rows of another by putting both under
each other and looking at what has equal keys.  Rows that lie together, by
repository say, are not dealt for it; others are dealt by all keys, as in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def handed(rows: DataFrame, given: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``, an array of structs: the other columns of the rows of ``given`` that have equal keys.

    Exploded, it is an inner join, or a left one with an outer explode.
    Columns that are NULL are equal to none.
    """
    others = [c for c in given.columns if c not in keys]
    known = given.dropna(subset=list(keys)).select(*keys, F.struct(*others).alias("_given"))
    both = rows.unionByName(known, allowMissingColumns=True)
    met = both.withColumn(name, F.collect_list("_given").over(Window.partitionBy(*keys)))
    return met.where(F.col("_given").isNull()).drop("_given")
