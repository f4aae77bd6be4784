"""Entries from files, tables, turns and pages; sinks and streams."""

import random

import pytest
from pyspark.sql import functions as F

from credsift.operators.entries import corpus_size
from credsift.operators.matching import redact
from credsift.options import ScanOptions
from credsift.plans.scan import scan_entries
from credsift.schemas import ENTRIES, FINDING_COLUMNS
from credsift.sources.entries import entries_from_files, entries_from_table, entries_from_turns, file_listing, rules_table
from credsift.sources.sinks import write_findings
from credsift.streaming.scan import scan_stream, write_new_findings

KEY_LINE = "cloud.id=AKIA" + "".join(random.Random(11).choices("BCDFGHJKLMNPQRSTVWXZ23456789", k=16))


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.env").write_text(KEY_LINE)
    (tmp_path / "sub" / "b.env").write_text("x\n" + KEY_LINE)
    (tmp_path / "sub" / "c.md").write_text(KEY_LINE)
    (tmp_path / "big.env").write_text(KEY_LINE + " " * (1 << 20))
    entries = entries_from_files(spark, str(tmp_path))
    assert [f.dataType for f in entries.schema] == [f.dataType for f in ENTRIES]
    assert sorted((r.file, r.line) for r in scan_entries(entries).collect()) == [
        ("a.env", 1), ("big.env", 1), ("sub/b.env", 2), ("sub/c.md", 1)]
    small = entries_from_files(spark, str(tmp_path), max_file_bytes=1 << 20)
    assert sorted(r.path for r in small.collect()) == ["a.env", "sub/b.env", "sub/c.md"]
    assert {r.path for r in entries_from_files(spark, f"file://{tmp_path}", "*.md").collect()} == {"sub/c.md"}
    listing = file_listing(spark, str(tmp_path)).withColumn("root", F.lit("t"))
    [total] = corpus_size(listing, limit_bytes=1 << 20).collect()
    assert total.bytes == 4 * len(KEY_LINE) + 2 + (1 << 20) and total.over_limit


def test_table_turns_and_pages(spark):
    df = spark.createDataFrame([(3, "p", KEY_LINE, "dev")], "id long, name string, body string, who string")
    [row] = entries_from_table(df, "name", "body", "id", meta={"commit_author": "who"}).collect()
    assert (row.repo, row.entry_seq, row.path, bytes(row.content).decode(), row.commit_author, row.commit) == (
        "", 3, "p", KEY_LINE, "dev", None)
    with pytest.raises(ValueError):
        entries_from_table(df, "name", "body", "id", meta={"author": "who"})
    turns = spark.createDataFrame([(7, 2, "user", KEY_LINE)], "conv_id long, turn long, role string, text string")
    assert [r.file for r in scan_entries(entries_from_turns(turns, "conversations")).collect()] == ["7/2"]
    pages = spark.createDataFrame([(1, "u/x", f"<p>\n{KEY_LINE}\n")], "page_id long, url string, html string")
    assert [(r.file, r.line) for r in scan_entries(entries_from_turns(pages, "pages")).collect()] == [("u/x", 2)]
    with pytest.raises(ValueError):
        entries_from_turns(pages, "mail")


def test_rules_table(spark):
    rows = rules_table(spark).collect()
    assert len(rows) == 74 and rows[0].rule_id == rows[0].type == "aws_access_key_id" and rows[4].grp == 0


def test_write_findings(spark, entries, tmp_path):
    findings = scan_entries(entries(("a", KEY_LINE), ("b", "SECRET=0123456789ab")))
    write_findings(findings.select(*FINDING_COLUMNS), str(tmp_path / "f"))
    assert {p.name for p in (tmp_path / "f").glob("severity=*")} == {"severity=critical", "severity=medium"}
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


def test_redact_hides_what_a_scan_leaves_out(spark):
    text = f"// {KEY_LINE}\n{KEY_LINE} and password='hunter2222'\r\npassword = 'changeme'\n" + "y" * 5000 + f" {KEY_LINE}"
    df = spark.createDataFrame([(text,), ("plain",)], "text string")
    hidden, plain = (r.text for r in redact(df, "text").collect())
    key = KEY_LINE.removeprefix("cloud.id=")
    assert hidden == text.replace(key, key[:4] + "*" * 12 + key[-4:]).replace("hunter2222", "hunt**2222")
    assert plain == "plain"


def files_of(df, path, batches):
    for batch in range(batches):
        df.where(F.col("entry_seq") % batches == batch).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def arriving(spark, entries, tmp_path):
    """Twelve entries over four paths in three files, every path with the same secret."""
    df = entries(*[(f"f{i % 4}", f"{KEY_LINE}\npassword = 'abcdefgh{i % 2}'") for i in range(12)])
    df = df.withColumn("commit_date", F.timestamp_seconds(F.col("entry_seq") + 1_700_000_000))
    files_of(df, str(tmp_path / "in"), 3)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return stream


def test_scan_stream(spark, arriving, tmp_path):
    found = scan_stream(arriving(), options=ScanOptions(context="none"))
    for _ in range(2):  # started again from its checkpoint, nothing comes twice
        (found.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.file, r.type) for r in rows) == sorted(
        (f"f{i}", t) for i in range(4) for t in ("aws_access_key_id", "hardcoded_password"))


def test_write_new_findings(spark, arriving, tmp_path):
    table = str(tmp_path / "table")
    write_new_findings(arriving(), table, str(tmp_path / "log")).awaitTermination()
    first = spark.read.parquet(table).count()
    # a second reader of the same files with a log of its own finds everything in the table
    write_new_findings(arriving(), table, str(tmp_path / "log2")).awaitTermination()
    assert first == 8 == spark.read.parquet(table).count()


def test_repeats_across_batches_keep_the_first(spark, entries, tmp_path):
    """A key that comes back in later batches, and twice in one, is written once, with its first place."""
    later = "\n".join(["x"] * 5)
    df = entries(
        ("r", 0, "p", f"a\n{KEY_LINE}"), ("r", 1, "p", KEY_LINE), ("r", 2, "q", f"{later}\n{KEY_LINE}"), ("r", 3, "p", KEY_LINE),
        ("s", 4, "p", KEY_LINE), ("r", 5, "q", KEY_LINE),
    )
    files_of(df, str(tmp_path / "in"), 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    for _ in range(2):
        write_new_findings(stream, table, log, groups=4).awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert sorted((r.repo, r.file, r.line) for r in rows) == [("r", "p", 2), ("r", "q", 6), ("s", "p", 1)]
    # more input to the same log: only what is new
    files_of(entries(("r", 6, "p", KEY_LINE), ("r", 8, "z", KEY_LINE)), str(tmp_path / "in"), 1)
    write_new_findings(stream, table, log, groups=4).awaitTermination()
    assert sorted((r.repo, r.file) for r in spark.read.parquet(table).collect()) == [("r", "p"), ("r", "q"), ("r", "z"), ("s", "p")]
