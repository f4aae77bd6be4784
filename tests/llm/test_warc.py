import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from credsift.llm import warc


def back(spark, rows, schema="page_id long, url string, html string", **more):
    manifest = warc.write_archives(spark.createDataFrame(rows, schema), **more)
    answers, others = (warc.read_archives(spark, manifest.where(F.col("series") == s)) for s in ("answers", "others"))
    return manifest, warc.transactions(answers, others).collect()


ROWS = [
    (1, "http://a/b?c#d", "x"), (2, None, "x"), (3, "u\r\nv: w", None), (4, "q", ""), (5, "http://a", "y\r\n\r\nWARC/1.1\r\n"),
    (6, "http://ä/é", "y\r\n\r\nWARC/1.1\r\n"), (7, "http://a", "ünï \x00 🤗"), (8, "http://big", "z" * 300_000), (0, "http://late", "x"),
]


def test_round_trip(spark):
    _, got = back(spark, ROWS)
    first = {}
    for i, _, html in sorted(ROWS):
        first.setdefault(html or "", i)
    assert len(got) == len(ROWS)
    for r in got:
        page = int(r["page"])
        payload = (dict((i, h) for i, _, h in ROWS)[page] or "").encode()
        answer = r["response"]
        assert answer["payload_bytes"] == len(payload)
        assert answer["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        origin = first[payload.decode()]
        assert answer["type"] == ("response" if origin == page else "revisit")
        assert r["refers_to_page"] == (None if origin == page else str(origin))
        assert answer["payload"] == (payload if origin == page else None)
        assert r["request"]["block"].startswith(b"GET /") and r["metadata"]["block"] == b"payload-bytes: %d\r\n" % len(payload)


def test_small_payloads_are_never_revisits(spark):
    _, got = back(spark, ROWS, min_bytes=5)
    assert {int(r["page"]): r["response"]["type"] for r in got if r["response"]["type"] == "revisit"} == {6: "revisit"}


def test_repeated_rows_null_keys_and_empty_table(spark):
    _, got = back(spark, [(5, "u", "x"), (5, "u", "x"), (5, "u", "other"), (None, "u", "x"), (None, None, None), (9, "u", "x")])
    assert sorted((r["page"], r["response"]["type"], r["refers_to_page"]) for r in got if r["response"]["payload_bytes"] == 1) == [
        ("", "revisit", "5"), ("5", "response", None), ("5", "response", None), ("9", "revisit", "5")
    ]
    assert len(got) == 6 and all(r["request"] and r["metadata"] for r in got)
    manifest, got = back(spark, [])
    assert got == [] and manifest.count() == 0


def test_archives_rotate_and_are_plain_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    manifest, got = back(spark, ROWS)
    assert len(got) == len(ROWS)
    archive = manifest.where("series = 'answers'").first()
    raw = gzip.open(archive["path"].removeprefix("file:")).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"Content-Type: application/http" in raw


def test_damage_is_noticed():
    good = warc.record("response", "urn:x", "2000-01-01T00:00:00Z", "application/http", b"HTTP/1.1 200 OK\r\n\r\nabc", WARC_Payload_Digest="sha1:WRONG")
    import io

    headers, block = next(warc.records_of(io.BytesIO(good)))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(headers, block)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records_of(io.BytesIO(good[:-12])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records_of(io.BytesIO(b"junk\r\n")))
