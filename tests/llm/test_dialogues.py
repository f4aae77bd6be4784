"""Repair of conversations against the cheapest of all edits, found by plain search."""

import random
import re
import zlib
from hashlib import sha256
from heapq import heappop, heappush

import pytest

from credsift.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string"


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines): shortest way over (place, roles so far); the least letters first among equal costs."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        due = "a" if state == "u" else "u"
        heappush(heap, (cost + 3, audit + "I", at, due, (*lines, {"u": "user:", "a": "assistant:"}[due])))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
        if found[at] in ("blank", "duplicate"):
            continue
        more = 3 if found[at] == "truncated" else 0
        name = {"u": "user", "a": "assistant"}[due]
        heappush(heap, (cost + 3 + more, audit + "R", at + 1, due, (*lines, f"{name}:{text}")))
        if role[:1] == due or (role[:1] == "s" and state == ""):
            heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))


def expected(turns):
    convs = {}
    for conv, turn, role, text in turns:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=order)
        found, times = faults(rows), [t for t, *_ in rows if t is not None]
        cost, audit, lines = cheapest(rows)
        out[conv] = (
            max(times) - min(times) + 1 - len(set(times)) if times else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            cost, audit, sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def repaired(spark, turns, size=dialogues.CHUNK, parts=3):
    df = spark.createDataFrame(turns, SCHEMA).repartition(parts)
    return {r[0]: tuple(r)[1:] for r in dialogues.summarise(dialogues.repair(df, size=size)).collect()}


def conversation(rng, conv, n, roles=("user", "assistant", "system", "tool", "User", "", None)):
    weights = [6, 6, 2, 1, 1, 1, 1][: len(roles)]
    texts = ["Yes.", "No!", "cut off", " \t", "", None, "Why? ", "a\nb."]
    rows = []
    for i in range(n):
        text = rng.choice(texts)
        if text and text.strip() and rng.random() < 0.7:
            text = f"{i} {text}"
        turn = rng.choice([i, i, i, i + 2, None]) if n < 40 else i
        rows.append((conv, turn, rng.choices(roles, weights)[0], text))
    return rows


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_against_search(spark, size):
    rng = random.Random(size)
    turns = [row for conv in range(60) for row in conversation(rng, conv, rng.randrange(1, 12))]
    assert repaired(spark, turns, size) == expected(turns)


def test_one_long_conversation(spark):
    """Nearly all turns are in one conversation, cut into many chunks."""
    rng = random.Random(9)
    turns = conversation(rng, 1, 700) + conversation(rng, 2, 5)
    assert repaired(spark, turns, size=16) == expected(turns)


@pytest.mark.parametrize("role, text", [("tool", "fine."), ("user", "fine."), ("assistant", "cut"), ("tool", "cut")])
def test_chunks_that_do_not_converge(spark, role, text):
    turns = [(1, i, role, f"{i} {text}") for i in range(301)]
    assert repaired(spark, turns, size=8) == expected(turns)


def test_copies_and_nothing_else(spark):
    turns = [(1, i, "user", "again.") for i in range(200)] + [(1, 7, "user", "again.")] * 50 + [(2, 0, "user", " ")] * 20
    assert repaired(spark, turns, size=8) == expected(turns)


def test_chunks_start_from_guesses(spark, monkeypatch):
    """The passes correct guesses that are wrong: without them the result is another one."""
    turns = [(1, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(100)] + [(1, 100, "system", "s.")]
    assert repaired(spark, turns, size=7) == expected(turns)
    monkeypatch.setattr(dialogues, "settle", lambda chunks, run, forwards: chunks)
    assert repaired(spark, turns, size=7) != expected(turns)


def test_repaired_turns(spark):
    rng = random.Random(4)
    turns = [row for conv in range(20) for row in conversation(rng, conv, rng.randrange(1, 9))]
    df = spark.createDataFrame(turns, SCHEMA)
    rows = dialogues.repaired_turns(dialogues.repair(df, size=4)).collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r["conv"], []).append((r["turn"] is not None, r["turn"] or 0, bytes(r["line"]), r["nth"], f"{r['role']}:{r['text']}"))
    want = expected(turns)
    for conv, summary in want.items():
        lines = "\n".join(x[-1] for x in sorted(by_conv.get(conv, [])))
        assert sha256(lines.encode()).hexdigest() == summary[-1]


def test_damage(spark):
    turns = [(c, t, r, "One. Two! Three?") for c in (0, 1, None) for t in (*range(20), None) for r in ("system", None)]
    damaged, copies = dialogues.damage(spark.createDataFrame(turns, SCHEMA))
    got = [tuple(r) for r in damaged.select("conv_id", "turn", "role", "text", copies).collect()]
    want = []
    for c, t, r, text in turns:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, role = zlib.crc32(name.encode()) % 20, " " if r is None else r
        if kind:
            text = {1: "", 2: "One Two Three"}.get(kind, text)
            want.append((c, t, "user" if kind == 4 else role, text, 2 if kind == 3 else 1))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_null_and_clashing(spark):
    assert repaired(spark, []) == {}
    turns = [(None, None, None, None), (None, 2, "user", "Hi."), (None, 3, "assistant", "Ho.")]
    assert repaired(spark, turns) == expected(turns)
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 9)], SCHEMA + ", conv string, copies int")
    assert dialogues.summarise(dialogues.repair(wide)).collect()[0]["audit"] == "KI"
