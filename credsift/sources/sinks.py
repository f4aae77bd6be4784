"""Where findings go."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.functions.text import display_url
from credsift.operators.findings import cap_total
from credsift.schemas import FINDING_COLUMNS


def write_findings(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "severity", mode: str = "errorifexists"
) -> None:
    """Findings as a flat table, one folder per severity."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def scan_report(
    findings: DataFrame, stats: DataFrame, scanned_at: datetime | Column, max_findings: int | None = None
) -> DataFrame:
    """One nested row per repository: URL, time, statistics, findings in scan order.

    A report holds a repository's findings in one row.  Where that is too much,
    the caller states a cap, or writes the flat table by ``write_findings``.
    """
    when = scanned_at if isinstance(scanned_at, Column) else F.lit(scanned_at)
    order = ("entry_seq", "line", "rule_ord", "match_ord")
    listed = (
        cap_total(findings, max_findings)
        .groupBy("repo")
        .agg(F.collect_list(F.struct(*order, F.struct(*FINDING_COLUMNS).alias("finding"))).alias("sorted"))
        .select("repo", F.transform(F.array_sort("sorted"), lambda f: f["finding"]).alias("findings"))
    )
    counts = F.struct("total_commits_scanned", "total_files_scanned", "total_findings")
    return stats.join(listed, "repo", "left").select(
        display_url(F.col("repo")).alias("repo_url"),
        when.cast("timestamp").alias("scanned_at"),
        counts.alias("stats"),
        F.coalesce("findings", F.array().cast(listed.schema["findings"].dataType)).alias("findings"),
    )


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reports as JSON lines, the form a caller of a scan gets back."""
    report.write.mode(mode).json(path)
