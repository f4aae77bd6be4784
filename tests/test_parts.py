"""Texts in parts and files in ranges give what whole texts give."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credsift.functions import matching
from credsift.operators.parts import split_entries
from credsift.options import ScanOptions
from credsift.plans.scan import scan_entries, scan_parts
from credsift.sources.entries import entries_from_files
from credsift.sources.ranges import Range, parts_from_files, read_range

COLUMNS = ("repo", "file", "line", "type", "matched_value", "context", "rule_ord", "match_ord")


def secret(rng):
    return "AKIA" + "".join(rng.choices("BCDFGHJKLMNPQRSTVWXZ23456789", k=16))


def text(rng, n):
    """Lines with keys, repeats, blanks, very long and invalid ones."""
    known = [secret(rng) for _ in range(3)]
    lines = []
    for _ in range(n):
        lines.append(rng.choice([
            b"", b"plain words", b"x" * rng.randrange(90), f"id {rng.choice(known)} end".encode(), f"id {secret(rng)}".encode(),
            b"password = 'abcdefgh1'", b"\xff\xfe id " + known[0].encode(), "é 🙂".encode(), f"a {known[1]} b {known[2]}".encode(), b"cr\r",
        ]))
    return b"\n".join(lines) + rng.choice([b"", b"\n", b"\n\n"])


def rows(findings):
    return sorted((tuple(r) for r in findings.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("size", [7, 64])
def test_parts_equal_the_whole(spark, entries, size):
    rng = random.Random(size)
    df = entries(
        *[("r", i, f"p{i % 5}", text(rng, rng.randrange(40))) for i in range(12)], ("r", 90, "nul", b"id " + secret(rng).encode() + b"\n\x00"),
        ("r", 91, "empty", b""), ("r", 92, "lf", b"\n"), ("r", 93, "go.sum", b"id " + secret(rng).encode()),
    )
    parts = split_entries(df, size)
    assert rows(scan_parts(parts)) == rows(scan_entries(df))
    if size == 7:
        for options in (ScanOptions(context="raw", line_filter="as_coded"), ScanOptions(max_findings_per_entry=3, max_findings=9)):
            assert rows(scan_parts(parts, options=options)) == rows(scan_entries(df, options=options))


def test_large_text_is_the_work_of_many_tasks(spark, entries):
    rng = random.Random(2)
    keys = [secret(rng) for _ in range(40)]
    filler = "words without anything to find in them " * 20
    body = "\n".join(filler if i % 500 else keys[i // 500 % 40] for i in range(20_000))
    df = entries(("big.txt", body))
    parts = split_entries(df, 1 << 20)
    sizes = [r.n for r in parts.select(F.octet_length("content").alias("n")).collect()]
    assert len(sizes) == -(-len(body) // (1 << 20)) and max(sizes) < (1 << 20) + 2_000
    found = scan_parts(parts).select("line", "matched_value").collect()
    assert sorted(r.line for r in found) == [500 * i + 1 for i in range(40)]


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_files_in_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    (tmp_path / "sub").mkdir()
    for i in range(6):
        (tmp_path / ("sub" if i % 2 else ".") / f"f{i}").write_bytes(text(rng, rng.randrange(60)))
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"id " + secret(rng).encode())
    whole = scan_entries(entries_from_files(spark, str(tmp_path)))
    parts = parts_from_files(spark, str(tmp_path), range_bytes=size)
    assert rows(scan_parts(parts)) == rows(whole)
    assert parts_from_files(spark, f"file://{tmp_path}", range_bytes=size).count() == parts.count()


@pytest.mark.parametrize("size", [1, 2, 5, 17])
def test_ranges_hold_every_byte_once(size):
    rng = random.Random(size)
    for _ in range(30):
        raw = b"".join(rng.choice([b"\n", b"a", b"bcd", b"\n\n"]) for _ in range(rng.randrange(30)))
        found = [
            x for k, at in enumerate(range(0, max(1, len(raw)), size))
            if (x := read_range(pa.BufferReader(raw), Range("f", k, at, min(at + size, len(raw)), len(raw))))
        ]
        assert b"\n".join(content for _, content, _ in found) == raw
        for (_, content, after), (before, following, _) in zip(found, found[1:]):
            assert before == content.split(b"\n")[-1] and after == following.split(b"\n")[0]
        assert found[0][0] is None and found[-1][2] is None


def test_tasks_take_several_ranges(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0123456\n" * 8_192)
    parts = parts_from_files(spark, str(tmp_path), range_bytes=16)
    assert parts.count() == 4_096
    assert parts.rdd.getNumPartitions() <= 65


def test_parts_are_gated_by_their_own_lines(spark, monkeypatch):
    """A part whose neighbours alone hold secrets is not searched: they are lines of other parts."""
    none = "cast(array() AS array<struct<rule_ord: int, match_ord: int, raw: string>>)"
    monkeypatch.setattr(matching, "_line_secrets", lambda line, *_, **__: f"if({line} = 'clean', raise_error('searched'), {none})")
    text = f"id {secret(random.Random(4))}"
    own = F.struct(F.lit(1).alias("lo"), F.lit(1).alias("hi"), F.lit("clean").alias("t"))
    df = spark.createDataFrame([(f"{text}\nclean\n{text}",)], "t string")
    assert df.select(matching.content_hits(F.col("t"), own=own).alias("h")).first().h is None
