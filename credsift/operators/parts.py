"""Entries in parts: texts too large for one task, cut at line ends.

A part is a row of its entry's columns with ``part``, its place in the text,
``content``, whole lines without the line end it was cut at, and ``before`` and
``after``, the lines next to it (null at the ends of the text).  Lines are
numbered once all parts of an entry have counted theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsift.functions.filters import is_binary, skip_path
from credsift.functions.matching import content_hits
from credsift.functions.text import let
from credsift.operators.findings import dedupe_findings
from credsift.operators.matching import rule_value
from credsift.options import ScanOptions
from credsift.rules import DEFAULT_RULES, Rule
from credsift.session import materialise

PART_BYTES = 16 << 20
PLACE = ("repo", "entry_seq", "path", "commit", "commit_message", "commit_author", "commit_date")


def _first_line(raw: Column) -> Column:
    return F.substring_index(raw.cast("string"), "\n", 1).cast("binary")


def _last_line(raw: Column) -> Column:
    return F.substring_index(raw.cast("string"), "\n", -1).cast("binary")


def _parts(content: Column, size: int) -> Column:
    """``array<struct<part, before, content, after>>`` of a binary column."""
    length = F.octet_length(content)

    def cut(k: Column) -> Column:
        """Behind the first line end in the k-th stretch, of which the first byte is the last of the one before."""
        stretch = F.substring(content, k * size, F.lit(size))
        found = F.octet_length(_first_line(stretch))
        return F.when(found < F.octet_length(stretch), k * size + found)

    stretches = F.when(length > size, F.sequence(F.lit(1), F.floor((length - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    cuts = F.filter(F.transform(stretches, cut), lambda c: c.isNotNull() & (c < length))
    bounds = F.concat(F.array(F.lit(0)), F.array_distinct(cuts), F.array(length))

    def pieces(b: Column) -> Column:
        last = F.size(b) - 2
        # the line end that a piece was cut at is no part of it
        raw = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.substring(content, F.get(b, i) + 1, F.get(b, i + 1) - F.get(b, i) - F.when(i < last, 1).otherwise(0)),
        )
        return let(raw, lambda r: F.transform(r, lambda text, i: F.struct(
            i.alias("part"), F.when(i > 0, _last_line(F.get(r, i - 1))).alias("before"), text.alias("content"),
            F.when(i < last, _first_line(F.get(r, i + 1))).alias("after"),
        )))

    return let(bounds, pieces)


def split_entries(entries: DataFrame, part_bytes: int = PART_BYTES, spread: bool = True) -> DataFrame:
    """Entries as parts of about ``part_bytes``, cut at line ends; a longer line stays whole.

    Binary contents and skipped names are left out, as a part does not show
    them.  With ``spread``, parts are dealt to tasks of their own.
    """
    kept = entries.where(F.col("content").isNotNull() & ~skip_path(F.col("path")) & ~is_binary(F.col("content")))
    parts = kept.select(*PLACE, F.explode(_parts(F.col("content").cast("binary"), part_bytes)).alias("_p")).select(*PLACE, "_p.*")
    return parts.repartition("repo", "entry_seq", "path", "part") if spread else parts


def part_hits(parts: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Hits as `entry_hits` gives them, lines numbered over all parts of an entry.

    The parts are scanned where they lie; what is written and put in order is
    their hits and numbers of lines.  An entry with a NUL byte in any part has none.
    """
    end = F.lit(b"\n")
    text = F.concat(
        F.coalesce(F.concat("before", end), F.lit(b"")), F.col("content"), F.coalesce(F.concat(end, F.col("after")), F.lit(b""))
    )
    lines = F.regexp_count(F.col("content").cast("string"), F.lit("\n")) + 1
    first = F.when(F.col("before").isNull(), 0).otherwise(1)
    own = F.struct(first.alias("lo"), (first + lines - 1).alias("hi"), F.col("content").cast("string").alias("t"))
    found = parts.where(~skip_path(F.col("path"))).select(
        *PLACE, "part", lines.cast("long").alias("_lines"), first.alias("_shift"), is_binary(F.col("content")).alias("_binary"),
        content_hits(text.cast("string"), rules, options, own=own).alias("_hits"),
    )
    entry = Window.partitionBy("repo", "entry_seq", "path")
    before = entry.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        materialise(found)
        .withColumn("_from", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
        .withColumn("_binary", F.max("_binary").over(entry))
        .where(~F.col("_binary") & (F.size("_hits") > 0))
    )
    hits = placed.select(*PLACE, "_from", "_shift", F.explode("_hits").alias("_h")).select(
        *PLACE, (F.col("_h.line_idx") - F.col("_shift") + F.col("_from")).cast("int").alias("line_idx"),
        "_h.rule_ord", "_h.match_ord", "_h.masked", "_h.context",
        rule_value(rules, "rule_id", F.col("_h.rule_ord")).alias("rule_id"),
    )
    if options.max_findings_per_entry is None:
        return hits.withColumn("entry_hits", F.lit(None).cast("int"))
    # the cap needs each key of an entry once, and how many there are
    once = dedupe_findings(hits, ("repo", "path", "rule_id", "masked", "entry_seq"))
    return once.withColumn("entry_hits", F.count(F.lit(1)).over(entry).cast("int"))
