"""Entries, the rows a scan reads, from tables, files, turns and pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift import schemas
from credsift.rules import DEFAULT_RULES, Rule

_META = ("commit", "commit_message", "commit_author", "commit_date")


def entries_from_table(
    df: DataFrame,
    path_col: str | Column,
    text_col: str | Column,
    seq_col: str | Column,
    repo_col: str | Column | None = None,
    meta: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Rows with a text column as entries.

    ``seq_col`` is a whole number that orders the entries of a repository; it
    decides which of two equal findings is the first.  ``meta`` maps commit
    columns to columns of ``df``; the others are NULL.
    """

    def column(value: str | Column) -> Column:
        return F.col(value) if isinstance(value, str) else value

    meta = dict(meta or {})
    if unknown := set(meta) - set(_META):
        raise ValueError(f"not entry columns: {sorted(unknown)}")
    values = {
        "repo": column(repo_col) if repo_col is not None else F.lit(""),
        "entry_seq": column(seq_col),
        "path": column(path_col),
        "content": column(text_col),
        **{name: column(meta[name]) if name in meta else F.lit(None) for name in _META},
        "from_history": F.lit(False),
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.ENTRIES])


def file_listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Path, length and modification time of all files under ``root``; no content is read."""
    return _binary_files(spark, root, glob).select("path", "length", "modificationTime")


def _binary_files(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def entries_from_files(
    spark: SparkSession, root: str, glob: str | None = None, repo: str = "", max_file_bytes: int | None = None
) -> DataFrame:
    """All files under ``root`` as entries, paths relative to it.

    A size limit is tested on the listing, so larger files are never read.
    Entries are ordered by path hash: a listing has no order of its own.
    """
    root_uri = root.rstrip("/")
    files = _binary_files(spark, root_uri, glob)
    if max_file_bytes is not None:
        files = files.where(F.col("length") <= max_file_bytes)
    plain_root = root_uri.split(":", 1)[1].lstrip("/") if ":" in root_uri else root_uri.lstrip("/")
    relative = F.substring_index(F.col("path"), f"/{plain_root}/", -1)
    return entries_from_table(files, relative, "content", F.xxhash64(relative), F.lit(repo))


def entries_from_turns(df: DataFrame, kind: str, repo_col: str | Column | None = None) -> DataFrame:
    """``kind="conversations"``: a turn is an entry, its path ``conv_id/turn``.
    ``kind="pages"``: a page is an entry, its path the URL."""
    if kind == "conversations":
        path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        seq = F.col("conv_id") * F.lit(1 << 20) + F.col("turn")
        return entries_from_table(df, path, "text", seq, repo_col)
    if kind == "pages":
        return entries_from_table(df, "url", "html", "page_id", repo_col)
    raise ValueError(f"kind={kind!r}, expected 'conversations' or 'pages'")


def rules_table(spark: SparkSession, extra: Iterable[Rule] = ()) -> DataFrame:
    """The rules as a table, user rules after the shipped ones."""
    rows = [
        (i, r.rule_id, r.rule_id, r.description, r.severity, r.java_pattern, r.group, list(r.anchors))
        for i, r in enumerate((*DEFAULT_RULES, *extra))
    ]
    return spark.createDataFrame(rows, schemas.RULES)
