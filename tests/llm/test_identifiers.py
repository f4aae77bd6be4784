"""Identifiers of fixed form against plain patterns, discovery against a walk over the graph."""

import random
import re
from math import exp, log1p

import pytest

from credsift.llm import identifiers

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if holds(k, m[0])]


def spans(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return {
        r["doc_id"]: [(s["kind"], s["start"], s["stop"], s["base"]) for s in r["spans"]]
        for r in identifiers.find_identifiers(docs, **options).collect()
    }


CASES = [
    "a@b.cd", "x a@b.c%x@y.zz tail", "a@b@c.de", "a@b..c a@b. a@-.-", "%@x.y-z.q.", "näme@dömain.de é a.b+c@d-e.f", "no@dot", "",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "001.002.003.255 256.1.1.1 1.1.1.0256", "12.34.56", "9.1.2.3.4", "v1.2.3.4x",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "5 4111 1111 1111 1111", "4111  1111 1111 1111",
    "00000000000000000000", "0000000000000", "12345678901234567890123", "4111 1111 1111 1111 2",
    "+1 (743) 555-3824", "+49 30 123456 ... +12", "+1(((((((2", "++1 555 123 4567", "+1 555 123 4567 8901 2345 6", "+1 555-123-456a",
    "+1 4111 1111 1111 1111", "🙂🙂 a@b.cd 🙂 +1 743 555 3824", "a@1.2.3.4", None, "\n\na@b.cd\n1.2.3.4\r\n",
]


def test_fixed_forms(spark):
    found = spans(spark, list(enumerate(CASES)))
    for i, text in enumerate(CASES):
        assert [s[:3] for s in found[i] if s[3]] == plain(text), text


def test_fixed_forms_of_random_texts(spark):
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "1", "23", "456", "+", "-", " ", "(", ")", "255", "4111111111111111", "é", "@x.yz", "1.2.3.4", "\n"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(40)))) for i in range(400)]
    found = spans(spark, rows, rounds=1)
    for i, text in rows:
        assert [s[:3] for s in found[i] if s[3]] == plain(text), text


def test_long_texts(spark):
    """Work is in proportion to the length: no run of characters is tried again from each of its places."""
    runs = ["a" * 300_000, "1" * 300_000, "1-" * 100_000, "1." * 100_000, "+1" + " " * 300_000, "a." * 100_000 + "@", "x@" + "y." * 100_000]
    rows = [(i, run + " end@mail.org") for i, run in enumerate(runs)] + [(99, "a@b.cd 1.2.3.4 " * 5_000)]
    found = spans(spark, rows, rounds=1)
    assert all(("email", len(t) - 12, len(t), True) in found[i] for i, t in rows[:6])
    assert len(found[99]) == 10_000


def number(rng, n):
    return "".join(rng.choices("0123456789", k=n))


@pytest.fixture(scope="module")
def contexts():
    """Phones and mail addresses after fixed words, a few of them in forms that no pattern takes."""
    rng = random.Random(3)
    rows, hidden = [], {}
    for i in range(60):
        form = f"+1 ({number(rng, 3)}) 555-{number(rng, 4)}"
        rows.append((i, f"some words then Call: {form} and more"))
        rows.append((100 + i, f"kept at mailto user{i}@mail.org today"))
        rows.append((200 + i, f"version {i}.{number(rng, 2)} of item {number(rng, 5)} costs {number(rng, 3)}"))
    for i in range(5):
        value = f"0{number(rng, 3)} 55{number(rng, 2)} {number(rng, 3)}"
        rows.append((300 + i, f"again Call: {value} now"))
        hidden[300 + i] = ("phone", 12, 12 + len(value), False)
        rows.append((310 + i, f"so mailto person{i}[at]host[dot]net ok"))
        hidden[310 + i] = ("email", 10, 10 + len(f"person{i}[at]host[dot]net"), False)
        rows.append((320 + i, f"number 0{number(rng, 9)} alone, item 77{number(rng, 7)}"))
    return rows, hidden


def test_discovery(spark, contexts):
    rows, hidden = contexts
    found = spans(spark, rows)
    assert {i: s for i, all_ in found.items() for s in all_ if not s[3]} == hidden
    assert all([s[:3] for s in found[i] if s[3]] == plain(t) for i, t in rows)


def walk(edges, rounds):
    """The rounds of `discover` over [(pattern, value, seed, kinds)]."""
    seeds = {(v, s): 1.0 for _, v, s, _ in edges if s}
    size = {}
    for p, *_ in edges:
        size[p] = size.get(p, 0) + 1
    scores, news = dict(seeds), {}
    for _ in range(rounds):
        known = {}
        for p, v, *_ in edges:
            for kind in identifiers.KINDS:
                if (v, kind) in scores:
                    known[p, kind] = known.get((p, kind), 0) + scores[v, kind]
        sure = {k: n / (size[k[0]] + identifiers.DOUBT) for k, n in known.items()}
        votes = {}
        for p, v, s, kinds in edges:
            for kind in () if s else kinds:
                if sure.get((p, kind), 0) >= identifiers.CONFIDENT:
                    votes.setdefault(v, {}).setdefault(kind, []).append(sure[p, kind])
        news = {}
        for v, of in votes.items():
            score, kind = max((1 - exp(sum(log1p(-c) for c in cs)), k) for k, cs in of.items())
            if score >= identifiers.ACCEPTED:
                news[v, kind] = score
        scores = seeds | news
    return news


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_against_walk(spark, contexts, rounds):
    rows, _ = contexts
    _, found = identifiers.marks(spark.createDataFrame(rows, SCHEMA))
    edges = identifiers.graph(found).withColumn("kinds", identifiers.may_be(identifiers.F.col("value"))).collect()
    want = walk([tuple(e) for e in edges], rounds)
    got = {(r["value"], r["kind"]): r["score"] for r in identifiers.discover(found, rounds).collect()}
    assert got == pytest.approx(want) and want


def test_empty_repeated_and_clashing(spark):
    assert spans(spark, []) == {}
    docs = spark.createDataFrame([(1, "a@b.cd", "r", "x"), (1, "a@b.cd", "r", "x"), (None, None, None, None)], "doc_id long, text string, row string, key string")
    rows = identifiers.find_identifiers(docs).collect()
    assert sorted(len(r["spans"]) for r in rows) == [0, 1, 1] and len({r["row"] for r in rows}) == 3


def test_no_python_in_the_plan(spark):
    plan = identifiers.find_identifiers(spark.createDataFrame([(1, "a@b.cd")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
