import random

import numpy as np
import pytest

from credsift.llm import minhash
from credsift.llm.graph import connected_components
from tests.llm.conftest import WORD, Sets, fold


def by_hand(rows):
    """(id: (set size, least id of the class)) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = WORD.findall(fold(text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    groups = Sets(sets)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                groups.link(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def near(spark, rows):
    return minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def family(rnd, start, size, words, edits):
    base = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(300)) for _ in range(words)]
    for k in range(size):
        text = list(base)
        for _ in range(rnd.randint(0, edits)):
            text[rnd.randrange(words)] = f"new{rnd.randrange(10**6)}"
        yield start + 3 * k, " ".join(text)


@pytest.mark.parametrize("cell", [250_000, 500])
def test_families_copies_and_odd_texts(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL_SHINGLES", cell)
    rnd = random.Random(cell)
    rows = [*family(rnd, 1, 25, 60, 5), *family(rnd, 500, 20, 150, 9), *family(rnd, 900, 3, 12, 1)]
    rows += [(2000 + i, "exactly the same text in many rows") for i in range(40)]
    rows += [(2100, "Exactly THE same\ttext in many\nrows"), (2101, "one two"), (2102, "ONE  two"), (2103, "one two three"),
             (2104, ""), (2105, None), (2106, " \n"), (2107, "x"), (2108, "w " * 4000)]
    rnd.shuffle(rows)
    got = {r["doc_id"]: r for r in near(spark, rows)}
    want = by_hand(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_repeated_rows_null_keys_and_empty_table(spark):
    text = "a b c d e f g h"
    got = near(spark, [(4, text), (4, text), (None, text), (None, "only one of its kind here"), (9, text), (None, None)])
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 4), (4, 4), (4, 4), (9, 4)]
    assert near(spark, []) == []


def test_sketch_fills_and_estimates():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 500, 5000):
        s = minhash.sketch(rnd.integers(0, 2**63, n, dtype=np.uint64))
        assert len(s) == minhash.BINS and s.max() < np.iinfo(np.uint64).max
    pool = rnd.integers(0, 2**63, 1000, dtype=np.uint64)
    shares = []
    for _ in range(30):
        x = rnd.permutation(pool)
        a, b = minhash.sketch(x[:800]), minhash.sketch(x[200:])  # 600 of 1000 in common
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.6) < 0.03


def test_steps_do_not_change_a_sketch(monkeypatch):
    elements = np.random.default_rng(3).integers(0, 2**63, 7, dtype=np.uint64)
    whole = minhash.sketch(elements)
    monkeypatch.setattr(minhash, "STEP", 1)
    assert (minhash.sketch(elements) == whole).all()


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3), (1, 2), (2, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    groups = Sets({x for pair in real for x in pair})
    for a, b in real:
        groups.link(a, b)
    assert got == {x: groups.find(x) for x in groups.up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("cell", [2048, 7])
def test_blocks_are_bounded_by_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL_ROWS", cell)
    rnd = random.Random(cell)
    rows = [(i, f"a{i // 12} page not found here b{i % 12}") for i in range(144)] + [*family(rnd, 500, 20, 40, 4)]
    rows += [(1000 + i, f"page not found error code {i}") for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near(spark, rows)}
    assert got == by_hand(rows)


def test_large_family_of_short_texts_that_are_alike_but_not_linked(spark):
    n = 224
    rows = [(i, f"a{i // n} page not found here b{i % n}") for i in range(n * n)]  # 1 of 3 shingles in common
    rows += [(60_000 + i, f"page not found error code {i}") for i in range(5000)]
    tail = " ".join(f"t{i}" for i in range(15))
    rows += [(70_000, f"a0 page not found here b0 {tail} x"), (70_001, f"a0 page not found here b0 {tail} y")]
    got = {r["doc_id"]: r["component_id"] for r in near(spark, rows)}
    assert got == {i: min(i, 70_000) for i, _ in rows}


def test_one_id_with_several_texts(spark):
    """Every text of an id is linked for itself, null ids too."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (None, b + " less"), (None, "c " + a), (8, "d e")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near(spark, rows))
    assert got == [(0, 37, 1, False), (0, 37, 1, False), (1, 36, 1, True), (1, 36, 1, True), (5, 37, 1, False), (6, 37, 1, False), (8, 1, 8, True)]


def test_carried_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(2, "a b c d e f", 7, "x"), (3, "a b c d e f", 8, "y")], "doc_id long, text string, n int, bucket string")
    got = minhash.near_duplicates(df, carry=("n", "bucket")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(2, 2, 2, True, 7, "x"), (3, 2, 2, False, 8, "y")]


@pytest.mark.parametrize("rows", [1024, 3])
def test_pairs_that_the_least_member_does_not_link(spark, monkeypatch, rows):
    """A chain: neighbours are alike, the ends are not, and every order of ids gives one class."""
    monkeypatch.setattr(minhash, "CELL_ROWS", rows)
    rnd = random.Random(rows)
    words = [f"w{i}" for i in range(140)]
    order = list(range(12))
    rnd.shuffle(order)
    texts = [(order[k], " ".join(words[4 * k : 4 * k + 80])) for k in range(12)] + [(100 + k, " ".join(words[k : k + 60])) for k in (0, 40, 80)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near(spark, texts)}
    assert got == by_hand(texts)
