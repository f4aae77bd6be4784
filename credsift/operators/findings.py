"""Operators over hits and findings: repeats, caps, order, statistics.

The order of a scan is ``entry_seq``, then line, rule and match.  Hits and
findings are the only rows that are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsift.functions.text import severity_rank
from credsift.operators.entries import SALTS

KEY = ("repo", "path", "rule_id", "masked")
IN_ENTRY = ("line_idx", "rule_ord", "match_ord")


def dedupe_findings(hits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The first hit of each (repository, rule, mask, path), or other ``key``.

    One aggregation, whose map side keeps one row per key: a key with very many
    hits does not travel, and there is one exchange.
    """
    order = ("entry_seq", *IN_ENTRY)
    order = tuple(c for c in order if c not in key)
    rest = [c for c in hits.columns if c not in (*key, *order)]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return hits.groupBy(*key).agg(first).select(*key, "_first.*").select(*hits.columns)


def cap_per_entry(findings: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` findings of each entry."""
    if n is None:
        return findings
    w = Window.partitionBy("repo", "entry_seq").orderBy(*IN_ENTRY)
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def dedupe_and_cap(hits: DataFrame, n: int | None = None) -> DataFrame:
    """Repeats and entry cap in one, entry after entry as a scan meets them.

    A key that the cap cuts off has not been reported, so a later entry of the
    same path may report it; ``dedupe_findings`` followed by ``cap_per_entry``
    would lose it.

    ``hits`` holds each key of an entry once with the entry's number of hits, as
    ``entry_hits`` of the scan leaves it.  In an entry of at most ``n`` hits the
    cap cuts nothing, so a key is reported there at the latest and every later
    row of it can go: of those rows one per key is kept, on the map side already.
    What is left of a path, its distinct keys and its entries over the cap,
    streams in order through the fold, which keeps the reported keys in memory.
    """
    if n is None:
        return dedupe_findings(hits)
    # rows of entries over the cap are a part of their own each, and all stay
    part = F.when(F.col("entry_hits") > n, F.col("entry_seq"))
    first = Window.partitionBy(*KEY, "_part").orderBy("entry_seq", *IN_ENTRY)
    rest = (
        hits.withColumn("_part", part)
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .drop("_part", "_n")
    )
    in_turn = rest.repartition("repo", "path").sortWithinPartitions("repo", "path", "entry_seq", *IN_ENTRY)
    return in_turn.mapInArrow(_reported_in_turn(n), hits.schema)


def _reported_in_turn(n: int):
    """Keeps, of rows in scan order, the keys that are new at their entry and within its cap."""

    def unseen(batch: pa.RecordBatch, reported: set[tuple[str, str]]) -> np.ndarray:
        """Rows whose key is not reported yet: each distinct key is looked up once."""
        codes, values = [], []
        for c in ("rule_id", "masked"):
            column = batch.column(c).dictionary_encode(null_encoding="encode")
            codes.append(column.indices.to_numpy().astype(np.int64))
            values.append(column.dictionary.to_pylist())
        keys, at = np.unique(codes[0] * len(values[1]) + codes[1], return_inverse=True)
        new = [(values[0][r], values[1][m]) not in reported for r, m in zip(*(x.tolist() for x in divmod(keys, len(values[1]))))]
        return np.flatnonzero(np.array(new, bool)[at])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_key = entry_key = None
        reported: set[tuple[str, str]] = set()
        taken = 0
        for batch in batches:
            rows = batch
            at = np.arange(len(batch))
            # rows are sorted: if the last one is of the path in work, all are, and reported keys change nothing
            if len(batch) and path_key == tuple(batch.column(c)[-1].as_py() for c in ("repo", "path")):
                at = unseen(batch, reported)
                rows = batch.take(pa.array(at))
            columns = (rows.column(c).to_pylist() for c in ("repo", "path", "entry_seq", "rule_id", "masked"))
            keep = np.zeros(len(batch), bool)
            for i, (repo, path, entry, rule, masked) in zip(at, zip(*columns)):
                if (repo, path) != path_key:
                    path_key, entry_key, reported, taken = (repo, path), entry, set(), 0
                elif entry != entry_key:
                    entry_key, taken = entry, 0
                if taken < n and (rule, masked) not in reported:
                    reported.add((rule, masked))
                    taken += 1
                    keep[i] = True
            yield batch.filter(pa.array(keep))

    return fold


def cap_total(findings: DataFrame, n: int | None = None, salts: int = SALTS) -> DataFrame:
    """Entries of each repository until one brings its findings to ``n``; that one is kept whole.

    An entry is kept when fewer than ``n`` findings come before it, which is
    what ``rank`` over ``entry_seq`` counts.  Salted parts are ranked first: a
    rank within a part is never above the rank in the repository.
    """
    if n is None:
        return findings
    part = Window.partitionBy("repo", "_salt").orderBy("entry_seq")
    whole = Window.partitionBy("repo").orderBy("entry_seq")
    return (
        findings.withColumn("_salt", F.pmod(F.xxhash64("entry_seq"), F.lit(salts)))
        .withColumn("_rank", F.rank().over(part))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.rank().over(whole))
        .where(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def scan_stats(
    entries: DataFrame, commits: DataFrame | None, findings: DataFrame, max_findings: int | None = None
) -> DataFrame:
    """Commits, distinct paths and findings per repository.

    ``entries`` are the scannable ones.  Those after the entry that filled the
    total cap have not been processed and do not count.
    """
    found = findings.groupBy(F.col("repo").alias("_repo")).agg(
        F.count(F.lit(1)).alias("_found"), F.max("entry_seq").alias("_last")
    )
    processed = entries.select("repo", "entry_seq", "path").join(
        found, F.col("repo").eqNullSafe(F.col("_repo")), "left"
    )
    if max_findings is not None:
        full = F.coalesce(F.col("_found"), F.lit(0)) >= max_findings
        processed = processed.where(~full | (F.col("entry_seq") <= F.col("_last")))
    stats = processed.groupBy("repo").agg(
        F.countDistinct("path").alias("total_files_scanned"),
        F.coalesce(F.max("_found"), F.lit(0)).alias("total_findings"),
    )
    if commits is None:
        stats = stats.withColumn("total_commits_scanned", F.lit(0).cast("long"))
    else:
        walked = commits.groupBy(F.col("repo").alias("_repo")).agg(F.countDistinct("hash").alias("_commits"))
        stats = stats.join(walked, F.col("repo").eqNullSafe(F.col("_repo")), "full").select(
            F.coalesce("repo", "_repo").alias("repo"),
            F.coalesce("_commits", F.lit(0)).alias("total_commits_scanned"),
            F.coalesce("total_files_scanned", F.lit(0)).alias("total_files_scanned"),
            F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
        )
    return stats.select("repo", "total_commits_scanned", "total_files_scanned", "total_findings")


def triage_order(findings: DataFrame) -> DataFrame:
    """Critical, high, medium; within them by commit date, then by place."""
    return findings.orderBy(
        severity_rank(F.col("severity")), "commit_date", "repo", "entry_seq", "line", "rule_ord", "match_ord"
    )


def triage_summary(findings: DataFrame) -> DataFrame:
    """Findings and files per severity and type, with subtotals (NULL is "all")."""
    return findings.rollup("severity", "type").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("repo", "file").alias("files")
    )


def new_findings(findings: DataFrame, earlier: DataFrame) -> DataFrame:
    """Findings whose id an earlier run has not reported."""
    return findings.join(earlier.select("id").distinct(), "id", "left_anti")
