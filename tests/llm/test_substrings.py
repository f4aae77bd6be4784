import random

import pytest

from credsift.llm import substrings
from tests.llm.conftest import WORD


def by_hand(rows, window):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def cleaned(spark, rows, window, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs, window, **more).collect()]


@pytest.mark.parametrize("window, alphabet", [(50, 4000), (8, 60), (3, 4), (2, 3)])
def test_against_brute_force(spark, window, alphabet):
    rnd = random.Random(window)
    word = lambda: f"w{rnd.randrange(alphabet)}"
    passages = [[word() for _ in range(rnd.randint(window - 1, 3 * window))] for _ in range(5)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rnd.randint(0, 4)):
            text += rnd.choice(passages) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(0, window))]
        rows.append((rnd.randrange(1000) * 50 + i, rnd.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(60_000 + i, rows[3][1]) for i in range(4)] + [(70_000, None), (70_001, ""), (70_002, "w1 " * 500)]
    assert sorted(cleaned(spark, rows, window)) == sorted(by_hand(rows, window))


def test_repeated_rows_and_null_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(9)), " ".join(f"b{i}" for i in range(9))
    rows = [(5, a), (5, a), (5, b), (7, b + " " + a), (None, a), (None, b), (9, b)]
    got = sorted(cleaned(spark, rows, 4), key=str)
    assert got == sorted(by_hand(rows, 4), key=str)
    assert cleaned(spark, [], 4) == []


def test_carried_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5), (2, "a b c", None, 6)], "doc_id long, text string, tag string, kept int")
    got = substrings.remove_repeats(docs, 2, carry=("tag",)).orderBy("doc_id").collect()
    assert [(r["tag"], r["original"], r["kept"]) for r in got] == [("x", "a b c", "a b c"), (None, "a b c", "")]
