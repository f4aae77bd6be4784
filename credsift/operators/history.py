"""Version-control history as tables: which file versions each commit is charged with.

Only hashes, paths and times move here.  Contents are attached last, or, in
the full scan, not at all: there each blob is scanned once, where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsift.functions.filters import is_binary, skip_path
from credsift.functions.text import trim_all
from credsift.operators.entries import cap_entries
from credsift.operators.ranks import ranked
from credsift.operators.reach import commit_nodes, least_depths
from credsift.operators.together import handed
from credsift.options import ATTRIBUTIONS, ScanOptions
from credsift.session import materialise

# entry_seq = commit rank * 2^32 + path rank; the HEAD tree ranks after all commits.
PATH_RANKS = 1 << 32
HEAD_RANK = 1 << 30


def reachable_commits(refs: DataFrame, commits: DataFrame, max_per_ref: int | None = None) -> DataFrame:
    """Commits reachable from a hash-type ref, each once, with its least depth; ``max_per_ref`` bounds the depth.

    All refs of all repositories are worked on together, in blocks of histories
    (see `least_depths`).
    """
    tips = refs.where(F.col("type") == "hash").select("repo", F.col("hash").alias("node"), F.lit(0).alias("depth")).distinct()
    depths = least_depths(commit_nodes(commits, 1), tips)
    found = depths.select("repo", F.col("node").alias("hash"), F.col("depth").cast("int").alias("depth"))
    return found if max_per_ref is None else found.where(F.col("depth") < max_per_ref)


def latest_commits(ref_commits: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` commits of each ref by committer time; columns ``repo, ref, hash, committer_when``."""
    w = Window.partitionBy("repo", "ref").orderBy(F.col("committer_when").desc(), "hash")
    return ref_commits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_parent(commits: DataFrame) -> DataFrame:
    """``repo, commit, parent``: parent 0 if it is among ``commits``, else NULL."""
    known = commits.select("repo", F.col("hash").alias("parent"))
    return (
        commits.select("repo", F.col("hash").alias("commit"), F.get("parents", F.lit(0)).alias("parent"))
        .join(known.withColumn("_known", F.lit(True)), ["repo", "parent"], "left")
        .select("repo", "commit", F.when(F.col("_known"), F.col("parent")).alias("parent"))
    )


def tree_diff(tree_files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changed paths between each commit and its parent: status A, M or D with both blobs.

    A tree serves as the new side of its own commit and as the old side of its
    children.  The commits it serves are handed to all of its files; one
    aggregation per (commit, path) then does what a full outer join would.  Both
    ask only that rows of a repository lie together, so trees that do are never
    dealt; others are dealt by commit, then by commit and path.  A commit
    without a parent meets no old side: all its files are added.
    """
    new = F.struct(F.col("commit").alias("tree"), "commit", F.lit(True).alias("_new"))
    old = F.struct(F.col("parent").alias("tree"), "commit", F.lit(False).alias("_new"))
    files = tree_files.select("repo", F.col("commit").alias("tree"), "path", "blob")
    roles = pairs.select("repo", F.inline(F.array(new, old))).repartition("repo")
    sides = handed(files, roles, ["repo", "tree"], "_roles").select("repo", "path", "blob", F.inline("_roles"))
    both = sides.groupBy("repo", "commit", "path").agg(
        F.max(F.when(~F.col("_new"), F.col("blob"))).alias("old_blob"),
        F.max(F.when(F.col("_new"), F.col("blob"))).alias("new_blob"),
    )
    status = F.when(F.col("old_blob").isNull(), "A").when(F.col("new_blob").isNull(), "D").otherwise("M")
    return both.where(~F.col("old_blob").eqNullSafe(F.col("new_blob"))).select(
        "repo", "commit", "path", status.alias("status"), "old_blob", "new_blob"
    )


def drop_absent_side(diff: DataFrame, attribution: str = "introducing") -> DataFrame:
    """The side a commit is charged with: its own blobs, or those it replaced."""
    if attribution not in ATTRIBUTIONS:
        raise ValueError(f"attribution={attribution!r}, expected one of {ATTRIBUTIONS}")
    side = "new_blob" if attribution == "introducing" else "old_blob"
    return diff.where(F.col(side).isNotNull()).select("repo", "commit", "path", F.col(side).alias("blob"))


def commit_meta(commits: DataFrame) -> DataFrame:
    """Trimmed message, author and author time of commits."""
    return commits.select(
        "repo",
        F.col("hash").alias("commit"),
        trim_all(F.col("message")).alias("commit_message"),
        F.col("author_name").alias("commit_author"),
        F.col("author_when").alias("commit_date"),
    )


def attach_commit_meta(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """The `commit_meta` of each row's commit."""
    met = handed(rows, commit_meta(commits).repartition("repo"), ["repo", "commit"], "_meta")
    return met.select(*rows.columns, F.inline("_meta"))


def usable_blobs(blobs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The blobs that are not binary, nor over a size limit if one is set."""
    if options.max_file_bytes is not None:
        blobs = blobs.where(F.col("size") <= options.max_file_bytes)
    return blobs.where(F.col("content").isNotNull() & ~is_binary(F.col("content"), options.binary_prefix_bytes))


def attach_blob(rows: DataFrame, blobs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Contents of the usable blobs; rows and blobs that lie together by repository are not dealt."""
    usable = usable_blobs(blobs, options).select("repo", "blob", "content")
    return handed(rows, usable, ["repo", "blob"], "_texts").select(*rows.columns, F.inline("_texts"))


def ref_ranks(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """``repo, hash, ref_rank``: the first hash-type ref, by name, that reaches each commit.

    Ranks spread from the tips like depths do, over edges of no length.
    """
    by_name = Window.partitionBy("repo").orderBy("name", "hash")
    tips = refs.where(F.col("type") == "hash").withColumn("depth", F.row_number().over(by_name))
    tips = tips.select("repo", F.col("hash").alias("node"), "depth")
    found = least_depths(commit_nodes(commits, 0), tips)
    return found.select("repo", F.col("node").alias("hash"), F.col("depth").alias("ref_rank"))


def commit_order(commits: DataFrame) -> DataFrame:
    """``repo, commit, rank``: ref after ref (if ``commits`` has a ``ref_rank``), the newest by committer time first."""
    order = [F.col("committer_when").desc(), F.col("hash").asc()]
    if "ref_rank" in commits.columns:
        order.insert(0, F.col("ref_rank").asc())
    slim = commits.select("repo", "hash", "committer_when", *[c for c in ("ref_rank",) if c in commits.columns])
    return ranked(slim, ["repo"], order, "rank").select("repo", F.col("hash").alias("commit"), "rank")


def _path_rank(files: DataFrame, rank: Column) -> DataFrame:
    path_rank = F.row_number().over(Window.partitionBy("repo", "from_history", "commit").orderBy("path"))
    return files.withColumn("entry_seq", (rank * F.lit(PATH_RANKS) + path_rank).cast("long"))


def entry_order(files: DataFrame, commits: DataFrame) -> DataFrame:
    """``entry_seq``: commits in `commit_order`, paths in order, then the HEAD tree.

    The number is put together from the rank of the commit in its repository and
    that of the path in its commit.  The former is not worked out by one task for
    a whole repository; files that lie together by it are not dealt for either.
    """
    ranks = commit_order(commits).repartition("repo")
    met = handed(files, ranks, ["repo", "commit"], "_ranks").select(*files.columns, F.inline_outer("_ranks"))
    rank = F.when(F.col("from_history"), F.col("rank")).otherwise(F.lit(HEAD_RANK).cast("long"))
    return _path_rank(met, rank).drop("rank")


def history_files(
    commits: DataFrame, tree_files: DataFrame, attribution: str = "introducing"
) -> DataFrame:
    """``repo, commit, path, blob, from_history``: the file versions each commit is charged with."""
    scanned = tree_files.where(~skip_path(F.col("path")))
    charged = drop_absent_side(tree_diff(scanned, first_parent(commits)), attribution)
    return charged.withColumn("from_history", F.lit(True))


def head_files(refs: DataFrame, tree_files: DataFrame) -> DataFrame:
    """All files of the HEAD commit, in the same form.

    Joined by repository alone: trees that lie together by it are not dealt again.
    """
    heads = refs.where(F.col("name") == "HEAD").groupBy("repo").agg(F.collect_set("hash").alias("_heads"))
    return (
        tree_files.where(~skip_path(F.col("path")))
        .join(heads, "repo")
        .where(F.array_contains("_heads", F.col("commit")))
        .select("repo", "commit", "path", "blob", F.lit(False).alias("from_history"))
    )


def history_union_head(history: DataFrame, head: DataFrame) -> DataFrame:
    """History first, then HEAD; repeats stay, they are dropped among the findings."""
    return history.unionByName(head)


def reached_commits(refs: DataFrame, commits: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``repo, hash, parents, committer_when, ref_rank`` of the commits that a scan walks over.

    They are a table in the shared folder: ranks, parents and statistics all start from it.
    """
    slim = commits.select("repo", "hash", "parents", "committer_when")
    reached = slim.join(ref_ranks(refs, commits), ["repo", "hash"])
    if options.max_commits_per_ref is not None:
        near = reachable_commits(refs, commits, options.max_commits_per_ref)
        reached = reached.join(near, ["repo", "hash"], "left_semi")
    return materialise(reached)


def walk(
    refs: DataFrame, commits: DataFrame, tree_files: DataFrame, options: ScanOptions = ScanOptions()
) -> tuple[DataFrame, DataFrame]:
    """Reachable commits, and all file versions to scan with their place in the scan."""
    reached = reached_commits(refs, commits, options)
    files = history_union_head(
        history_files(reached, tree_files, options.attribution), head_files(refs, tree_files)
    )
    return reached, entry_order(files, reached)


_ENTRY = (
    "repo", "entry_seq", "path", "content", "commit", "commit_message", "commit_author", "commit_date", "from_history"
)


def repository_entries(
    refs: DataFrame, commits: DataFrame, tree_files: DataFrame, blobs: DataFrame, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """History and HEAD as entries with content, capped per repository.

    The cap counts scannable entries, so blobs are judged before it and their
    contents attached after it, last of all: they move at most once, for the kept entries.
    """
    _, files = walk(refs, commits, tree_files, options)
    usable = usable_blobs(blobs, options).select("repo", "blob")
    kept = files
    if options.max_entries is not None:
        kept = cap_entries(files.join(usable, ["repo", "blob"], "left_semi"), options.max_entries)
    return attach_blob(attach_commit_meta(kept, commits), blobs, options).select(*_ENTRY)


def history_entries(
    refs: DataFrame, commits: DataFrame, tree_files: DataFrame, blobs: DataFrame, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """The history part of ``repository_entries``, before the cap."""
    reached = reached_commits(refs, commits, options)
    files = entry_order(history_files(reached, tree_files, options.attribution), reached)
    return attach_blob(attach_commit_meta(files, commits), blobs, options).select(*_ENTRY)


def head_entries(
    refs: DataFrame, commits: DataFrame, tree_files: DataFrame, blobs: DataFrame, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """The files of HEAD with their content and the HEAD commit's metadata."""
    files = _path_rank(head_files(refs, tree_files), F.lit(HEAD_RANK).cast("long"))
    return attach_blob(attach_commit_meta(files, commits), blobs, options).select(*_ENTRY)
