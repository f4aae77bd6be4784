import hashlib
import random

import pytest
from pyspark.sql import functions as F

from credsift.llm import winnowing


def fingerprinted(spark, rows, n_ranges=4, schema="doc_id long, text string"):
    return winnowing.fingerprint_documents(spark.createDataFrame(rows, schema), n_ranges=n_ranges).collect()


def by_hand(hashes, w=winnowing.WINDOW):
    """(hash, place) of every window's least hash, the rightmost of equal ones."""
    if not hashes:
        return []
    picked = []
    for i in range(max(1, len(hashes) - w + 1)):
        part = hashes[i : i + w]
        place = max(j for j, h in enumerate(part) if h == min(part)) + i
        if (hashes[place], place) not in picked:
            picked.append((hashes[place], place))
    return picked


def hashes_of(spark, texts, k=winnowing.K):
    grams = sorted({g for t in texts for g in ([t[i : i + k] for i in range(len(t) - k + 1)] or [t])})
    rows = spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.shiftright(F.xxhash64("g").bitwiseAND(F.lit(winnowing.HASH_MASK)), 31).alias("h"))
    table = {r["g"]: r["h"] for r in rows.collect()}
    return lambda t: [table[t[i : i + k]] for i in range(len(t) - k + 1)] or ([table[t]] if t else [])


def test_against_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc é\n🤗") for _ in range(rnd.choice([0, 1, 3, 7, 8, 9, 22, 23, 24, 40, 200]))) for _ in range(60)]
    texts += ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 40]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprinted(spark, rows)}
    edited = []
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited.append(t[: len(t) - q] + texts[(i + 1) % len(texts)][:q])
    hashes = hashes_of(spark, [t for t in texts + edited if t])
    for i, t in enumerate(texts):
        r, e, n = got[3 * i], edited[i], texts[(i + 1) % len(texts)]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        place = lambda marks: [((m + (-m % 2**31)) >> 31, -m % 2**31) for m in marks]
        a, b, c = by_hand(hashes(t)), by_hand(hashes(e)), by_hand(hashes(n))
        assert sorted(place(r["selected"])) == sorted(a) and sorted(place(r["edited_selected"])) == sorted(b)
        for other, name in ((b, "near_edited"), (c, "near_next")):
            x, y = {h for h, _ in a}, {h for h, _ in other}
            assert r[name] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_guarantee(spark):
    """Two texts that share a passage of w + k - 1 code points share a hash."""
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    for _ in range(5):
        shared = make(winnowing.WINDOW + winnowing.K - 1)
        got = fingerprinted(spark, [(1, make(90) + shared + make(40)), (2, make(10) + shared + make(200))])
        assert all(r["near_next"] > 0 for r in got)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, "")], [(None, "abc"), (None, None), (2, "x" * 50)], [(7, "same text here, and more")] * 6,
    [(i, "row") for i in range(30)],
])
@pytest.mark.parametrize("n_ranges", [1, 8])
def test_odd_rows(spark, rows, n_ranges):
    got = fingerprinted(spark, rows, n_ranges)
    assert len(got) == len(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_neighbours_across_ranges(spark):
    rows = [(i * i, f"text {i}") for i in range(57)]
    spark_rows = winnowing.with_next_text(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 8)
    got = {r["key"]: r["next_text"] for r in spark_rows.where("not guest").collect()}
    assert got == {i * i: f"text {(i + 1) % 57}" for i in range(57)}


def test_clashing_names(spark):
    got = fingerprinted(spark, [(1, "abc", 5, "x")], schema="doc_id long, text string, key int, selected string")
    assert got[0]["doc_id"] == 1
