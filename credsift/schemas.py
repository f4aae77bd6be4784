"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRIES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("entry_seq", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("commit", T.StringType()),
    T.StructField("commit_message", T.StringType()),
    T.StructField("commit_author", T.StringType()),
    T.StructField("commit_date", T.TimestampType()),
    T.StructField("from_history", T.BooleanType()),
])

RULES = T.StructType([
    T.StructField("rule_ord", T.IntegerType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType(), False),
    T.StructField("regex", T.StringType(), False),
    T.StructField("grp", T.IntegerType(), False),
    T.StructField("anchors", T.ArrayType(T.StringType())),
])

FINDING_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("commit", T.StringType()),
    T.StructField("commit_message", T.StringType()),
    T.StructField("commit_author", T.StringType()),
    T.StructField("commit_date", T.TimestampType()),
    T.StructField("matched_value", T.StringType()),
    T.StructField("context", T.StringType()),
]
FINDING = T.StructType(FINDING_FIELDS)
FINDING_COLUMNS = [field.name for field in FINDING_FIELDS]

STATS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("total_commits_scanned", T.LongType()),
    T.StructField("total_files_scanned", T.LongType()),
    T.StructField("total_findings", T.LongType()),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("repo_url", T.StringType()),
])

REFS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("hash", T.StringType()),
])
COMMITS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("parents", T.ArrayType(T.StringType())),
    T.StructField("message", T.StringType()),
    T.StructField("author_name", T.StringType()),
    T.StructField("author_when", T.TimestampType()),
    T.StructField("committer_when", T.TimestampType()),
])
TREE_FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("blob", T.StringType()),
])
BLOBS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("blob", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
