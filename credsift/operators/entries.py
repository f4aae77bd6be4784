"""Operators over entries: which of them are scanned, and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsift.functions.filters import is_binary, skip_path, within_size
from credsift.functions.matching import split_text
from credsift.functions.text import decode_text

# Hot repositories are cut in this many parts before their entries are ranked.
SALTS = 64


def scannable(
    entries: DataFrame, max_file_bytes: int | None = None, binary_prefix_bytes: int | None = None
) -> DataFrame:
    """Without skipped names and extensions, missing and binary contents, and those over a given limit."""
    return entries.where(
        ~skip_path(F.col("path"))
        & F.col("content").isNotNull()
        & within_size(F.col("content"), max_file_bytes)
        & ~is_binary(F.col("content"), binary_prefix_bytes)
    )


def split_lines(entries: DataFrame) -> DataFrame:
    """One row per line with its 0-based index and its 1-based number."""
    others = [c for c in entries.columns if c != "content"]
    return entries.select(
        *others, F.posexplode(split_text(decode_text(F.col("content")))).alias("line_idx", "line")
    ).withColumn("line_no", F.col("line_idx") + 1)


def first_in_repo(rows: DataFrame, n: int, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each repository by ``entry_seq``.

    Ranked within salted parts first: no task ever holds more than ``n`` rows
    per part of one repository, however large the repository is.
    """
    salt = F.pmod(F.xxhash64("entry_seq"), F.lit(salts))
    part = Window.partitionBy("repo", "_salt").orderBy("entry_seq")
    whole = Window.partitionBy("repo").orderBy("entry_seq")
    return (
        rows.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def cap_entries(entries: DataFrame, n: int | None = None, salts: int = SALTS) -> DataFrame:
    """The first ``n`` entries of each repository.

    Contents are never shuffled for it: with a content column only the keys are
    ranked, and the last key within the cap is joined back for the repositories
    that exceed it.
    """
    if n is None:
        return entries
    if "content" not in entries.columns:
        return first_in_repo(entries, n, salts)
    last = (
        first_in_repo(entries.select("repo", "entry_seq"), n, salts)
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("entry_seq").alias("_last"))
        .where(F.col("_n") == n)
        .select(F.col("repo").alias("_repo"), "_last")
    )
    return (
        entries.join(last, F.col("repo").eqNullSafe(F.col("_repo")), "left")
        .where(F.col("_last").isNull() | (F.col("entry_seq") <= F.col("_last")))
        .drop("_repo", "_last")
    )


def corpus_size(files: DataFrame, root_col: str = "root", limit_bytes: int = 700 << 20) -> DataFrame:
    """Total file size per root, and whether it is over the limit."""
    return files.groupBy(root_col).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn(
        "over_limit", F.col("bytes") > limit_bytes
    )
