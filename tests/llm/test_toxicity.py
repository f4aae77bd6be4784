import math
import random

import numpy as np
import pyarrow as pa
import pytest

from credsift.llm import toxicity

BAD = ["grubbel", "zonkard", "mudwit"]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(12)
    words = ["".join(rnd.choice(["an", "the", "or", "in", "ti", "on", "er", "st"]) for _ in range(rnd.randint(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        text, bad = [rnd.choice(words) for _ in range(rnd.randint(5, 60))], i % 6 == 0
        if bad:
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), rnd.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def classifier(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    labels = spark.createDataFrame(corpus[1], "key long, label int")
    return toxicity.fit_classifier(docs, labels.where(~toxicity.held_out(labels["key"])))


def scores(spark, classifier, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in toxicity.score_texts(docs, classifier).collect()}


def test_held_out_rows(spark, corpus, classifier):
    import zlib

    got = scores(spark, classifier, corpus[0])
    held = [(got[i]["predicted"], y) for i, y in corpus[1] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.98


@pytest.mark.parametrize("text", [
    "gru88el", "GRUBBEL!", "g-r-u-b-b-e-l", "z0nkard", "z.o.n.k.a.r.d", "zzzonkarrrd", "m u d w i t", "mudw1t", "a m u d w i t", "zonk@rd,",
    "m  u d\tw i 7", "mu*wit",
])
def test_obfuscated_words_are_found(spark, classifier, text):
    got = scores(spark, classifier, [(1, f"the anor {text} tion stin {text}"), (2, "the anor tion stin")])
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[1]["score"] > got[2]["score"]


def test_odd_texts(spark, classifier):
    rows = [(1, None), (2, ""), (3, " "), (None, "the"), (5, "1 2 3 4 5 6"), (6, "$$$ *** ..."), (7, "a b c d e f g"), (8, "x" * 50_000), (9, "é ü ñ")]
    got = scores(spark, classifier, rows)
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got.values())
    assert scores(spark, classifier, []) == {}


def test_long_text_is_judged_to_its_end(spark, classifier):
    assert scores(spark, classifier, [(1, "the on " * 60_000 + "zonkard grubbel")])[1]["predicted"] == 1


def test_carried_columns_with_clashing_names(spark, classifier):
    docs = spark.createDataFrame([(1, "the", 0.5, "k")], "doc_id long, text string, score double, key string")
    got = toxicity.score_texts(docs.withColumnRenamed("score", "other"), classifier, carry=("other", "key")).collect()
    assert (got[0]["other"], got[0]["key"]) == (0.5, "k")


def test_without_labels(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:20], "doc_id long, text string")
    found = toxicity.fit_classifier(docs, spark.createDataFrame([(1, None), (None, 1)], "key long, label int"))
    assert found.weights == {} and {r["predicted"] for r in toxicity.score_texts(docs, found).collect()} == {0}


def test_character_counts():
    counts = toxicity.character_counts(pa.array(["Ab", None, "é"])).reshape((toxicity.SYMBOLS,) * 3)
    assert counts[0, 1, 2] == 1 and counts[1, 2, 0] == 1 and counts.sum() == counts.sum() and counts[0, 27, 0] == 1


def test_viterbi_is_the_least_cost(classifier):
    """Against trying every reading of a short lattice."""
    from itertools import product

    model = np.random.default_rng(1).random((28, 28, 28)).tolist()
    places = toxicity.lattice(["m11d"]) + [[("a", 0.3), ("", 0.1), ("b", 0.2)]]

    def cost(options):
        total, a, b = sum(w for _, w in options), 0, 0
        for c in "".join(x for x, _ in options) + " ":
            total += model[a][b][toxicity.symbol(c)]
            a, b = b, toxicity.symbol(c)
        return total

    best = min(product(*places), key=cost)
    got = toxicity.viterbi(places, model)
    assert math.isclose(cost(best), min(map(cost, (o for o in product(*places) if "".join(x for x, _ in o) == got))))
