"""The registered queries on a small table set: against their SQL, or their contract's columns."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from credsift.llm.queries import QUERIES, SQL
from tests.llm.test_alignment import expected as aligned
from tests.llm.test_dialogues import expected
from tests.llm.test_identifiers import PLAIN, plain

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(want, key=repr)


COLUMNS = {
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_pseudolikelihood": {"doc_id": "bigint", "n_tokens": "bigint", "log_likelihood": "double"},
    "op7_winnow": {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
        "edited_fingerprint": "string", "near_edited": "double", "near_next": "double",
    },
    "op11_align_tokens": {
        "doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint",
        "count_sum": "bigint", "groups_sha256": "string",
    },
    "op12_find_identifiers": {
        "doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
        "base_sha256": "string", "spans": "string",
    },
    "op10_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_whole_table(spark, duck, name):
    df = QUERIES[name](spark, str(TABLES))
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    rows = df.collect()
    want = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    if name == "op10_pieces":  # what is encoded comes back whole
        assert all(r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() for r in rows)
    if name == "op7_winnow":
        ids = sorted(want)
        for r in rows:
            text, following = want[r["doc_id"]], want[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
            cut = len(text) // 4
            assert r["n_chars"] == len(text)
            assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
        same = {}
        assert all(same.setdefault(want[r["doc_id"]], r["fingerprint"]) == r["fingerprint"] for r in rows)
        assert sum(r["near_edited"] for r in rows) > 10 * sum(r["near_next"] for r in rows)


def test_whole_conversations(spark, duck):
    rows = QUERIES["op13_repair_conversations"](spark, str(TABLES)).collect()
    assert sorted(r["conv_id"] for r in rows) == sorted(x for x, in duck.execute("SELECT DISTINCT conv_id FROM conversations").fetchall())
    turns = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    want = expected([turn for t in turns for turn in damaged(*t)])
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert all(tuple(r)[1:] == want.get(r["conv_id"], none) for r in rows)


def damaged(conv, turn, role, text):
    kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
    role = "user" if kind == 4 else role
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def test_whole_documents_aligned(spark, duck):
    """op11 against two plain pointers over the bytes of every document."""
    rows = QUERIES["op11_align_tokens"](spark, str(TABLES)).collect()
    want = aligned(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(map(tuple, rows)) == sorted(want)


def test_whole_documents_identified(spark, duck):
    """op12 against plain patterns: counts and digest of the fixed forms, and all spans in order."""
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op12_find_identifiers"](spark, str(TABLES)).collect():
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{kind}"] for kind in PLAIN] == [sum(s[0] == kind for s in base) for kind in PLAIN]
        written = [":".join(map(str, s)) for s in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(written) <= set(spans) and len(set(spans)) == len(spans)
        assert spans == sorted(spans, key=lambda s: (list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])))
