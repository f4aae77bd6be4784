"""Whole scans: entries or repositories in, findings and statistics out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsift.functions.matching import content_hits
from credsift.functions.text import decode_text, finding_id, truncate_text
from credsift.operators.entries import cap_entries, scannable
from credsift.operators.findings import cap_per_entry, cap_total, dedupe_and_cap, dedupe_findings, scan_stats
from credsift.operators.history import commit_meta, usable_blobs, walk
from credsift.operators.matching import rule_value
from credsift.operators.parts import PLACE, part_hits
from credsift.operators.together import handed
from credsift.options import ScanOptions
from credsift.rules import DEFAULT_RULES, Rule
from credsift.schemas import FINDING_COLUMNS
from credsift.session import materialise

def explode_hits(rows: DataFrame, hits: Column, rules: Sequence[Rule], *more: str) -> DataFrame:
    """One row per hit, with the place it was found and ``more`` columns of the row."""
    return rows.select(*PLACE, *more, F.explode(hits).alias("_h")).select(
        *PLACE, *more, "_h.*", rule_value(rules, "rule_id", F.col("_h.rule_ord")).alias("rule_id")
    )


def entry_hits(
    entries: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Scannable entries to hits: no shuffle, nothing but hits leaves the scan stage."""
    text = decode_text(F.col("content"))
    kept = scannable(entries, options.max_file_bytes, options.binary_prefix_bytes)
    return explode_hits(kept, content_hits(text, rules, options), rules)


def keep_findings(hits: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Hits without repeats and within the caps."""
    if options.exact_cap:
        kept = dedupe_and_cap(hits, options.max_findings_per_entry)
    else:
        kept = cap_per_entry(dedupe_findings(hits), options.max_findings_per_entry)
    return cap_total(kept, options.max_findings)


def as_findings(hits: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """The 12 columns of a finding, with the repository and its place in the scan."""
    line = F.col("line_idx") + 1
    values = {
        "id": finding_id(
            F.col("repo"), F.col("rule_id"), F.col("masked"), F.col("path"), F.col("commit"), line
        ),
        "type": F.col("rule_id"),
        "severity": rule_value(rules, "severity", F.col("rule_ord")),
        "description": rule_value(rules, "description", F.col("rule_ord")),
        "file": F.col("path"),
        "line": line,
        "commit": F.col("commit"),
        "commit_message": truncate_text(F.col("commit_message")),
        "commit_author": F.col("commit_author"),
        "commit_date": F.col("commit_date"),
        "matched_value": F.col("masked"),
        "context": F.col("context"),
    }
    return hits.select(
        "repo", *[values[name].alias(name) for name in FINDING_COLUMNS], "entry_seq", "rule_ord", "match_ord"
    )


def scan_entries(
    entries: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Findings in a table of entries, for any number of repositories at once."""
    return as_findings(keep_findings(entry_hits(entries, rules, options), options), rules)


def scan_parts(
    parts: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Findings in parts of entries: `split_entries` of large texts, or ranges of large files.

    They are those of `scan_entries` on the whole texts.  Limits on the bytes of
    a file belong to where the parts are made.
    """
    return as_findings(keep_findings(part_hits(parts, rules, options), options), rules)


def blob_hits(files: DataFrame, usable: DataFrame, rules: Sequence[Rule], options: ScanOptions) -> DataFrame:
    """Files whose blob is among ``usable``, with the ``hits`` in it; blobs that no file has are not scanned.

    Blobs are rows beside the files they are in, and windows over both tell
    a blob that it has files, and files the hits of their blob.
    """
    texts = usable.dropna(subset=["repo", "blob"]).select("repo", "blob", "content")
    same = Window.partitionBy("repo", "blob")
    met = (
        files.withColumn("_file", F.lit(True)).unionByName(texts, allowMissingColumns=True)
        .withColumn("_files", F.count("_file").over(same)).withColumn("_texts", F.count("content").over(same))
        .where("_files > 0 and _texts > 0")
    )
    hits = F.when(F.col("_file").isNull(), content_hits(decode_text(F.col("content")), rules, options))
    found = met.select(*files.columns, "_file", hits.alias("_hits"))
    handed = found.withColumn("hits", F.first("_hits", ignorenulls=True).over(same))
    return handed.where("_file").select(*files.columns, "hits")


class RepositoryScan(NamedTuple):
    findings: DataFrame
    stats: DataFrame


def scan_repo_history(
    refs: DataFrame,
    commits: DataFrame,
    tree_files: DataFrame,
    blobs: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    options: ScanOptions = ScanOptions(),
) -> RepositoryScan:
    """Scan of all reachable file versions and the HEAD tree of every repository.

    A file version is a blob, and many commits and HEAD share it.  Each blob is
    scanned once, and only its hits are handed to the places it occurs.  All
    steps up to the findings ask for rows of a repository together and no more:
    files and blobs that lie together are not dealt on the way, and contents
    never move.  What findings and statistics are made of is written to the
    shared folder, so that the scan runs once: the hits that are kept, and a
    row without a rule for each path.
    """
    reached, files = walk(refs, commits, tree_files, options)
    placed = cap_entries(blob_hits(files, usable_blobs(blobs, options), rules, options), options.max_entries)
    met = handed(placed, commit_meta(commits).repartition("repo"), ["repo", "commit"], "_metas")
    known = met.withColumn("_meta", F.get("_metas", F.lit(0))).select(*placed.columns, "_meta", "_meta.*")
    path = F.array(F.lit(None).cast(placed.schema["hits"].dataType.elementType))
    hits = F.when(F.col("_meta").isNotNull() & F.col("hits").isNotNull(), F.concat(path, "hits")).otherwise(path)
    kept = materialise(_keep_beside_paths(explode_hits(known, hits, rules), options))
    findings = as_findings(kept.where("rule_id is not null"), rules)
    paths = kept.where("rule_id is null")
    return RepositoryScan(findings, scan_stats(paths, reached, findings, options.max_findings))


def _keep_beside_paths(rows: DataFrame, options: ScanOptions) -> DataFrame:
    """`keep_findings` of the rows that are hits; of those without a rule, the first of each path."""
    if options.max_findings_per_entry is None and options.max_findings is None:
        return dedupe_findings(rows)
    rows = materialise(rows)
    hits = keep_findings(rows.where("rule_id is not null"), options)
    return hits.unionByName(dedupe_findings(rows.where("rule_id is null")))
