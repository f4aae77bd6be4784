import random
from collections import Counter

import numpy as np
import pyarrow as pa

from credsift.llm import pseudolikelihood as pl
from credsift.llm.words import words_of


def test_gradient():
    rnd = np.random.default_rng(1)
    net = pl.Network(rnd.normal(0, 0.3, pl.Network.size()))
    around, token = rnd.integers(0, pl.TOKENS + 1, (64, 2 * pl.WIDTH)), rnd.integers(0, pl.TOKENS, 64)
    _, grad = net.gradient(around, token)
    for i in rnd.choice(np.flatnonzero(np.abs(grad.flat) > 2e-3), 12):
        kept, losses = net.flat[i], []
        for step in (0.01, -0.01):
            net.flat[i] = kept + step
            losses.append(-net.log_probabilities(around, token).astype(np.float64).mean())
        net.flat[i] = kept
        assert abs((losses[0] - losses[1]) / 0.02 - grad.flat[i]) < 2e-4


def test_probabilities_sum_to_one():
    net = pl.Network(np.random.default_rng(2).normal(0, 0.5, pl.Network.size()))
    around = np.tile([[3, 500, pl.PAD, 9]], (pl.TOKENS, 1))
    assert abs(np.exp(net.log_probabilities(around, np.arange(pl.TOKENS)).astype(np.float64)).sum() - 1) < 1e-4


def test_windows_stay_inside_a_text():
    words = words_of(pa.array(["a b c", None, "", "d", "e f"]))
    tokens, around = pl.windows(words, pl.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(pl.TOKENS)))
    a, b, c, d, e, f = tokens.tolist()
    p = pl.PAD
    assert around.tolist() == [[p, p, b, c], [p, a, c, p], [a, b, p, p], [p, p, p, p], [p, p, f, p], [p, e, p, p]]


def test_scores(spark):
    rnd = random.Random(3)
    follow = {f"w{i}": [f"w{(i * 7 + j) % 60}" for j in range(3)] for i in range(60)}

    def text(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rnd.choice(follow[out[-1]]))
        return out

    rows = [(i, " ".join(text(rnd.randint(20, 80)))) for i in range(800)]
    odd = [(9000, None), (9001, ""), (9002, " \n"), (None, "w1 w2"), (9003, "w1"), (9003, "w1"), (9004, "w3 " * 5000)]
    mixed = []
    for i in range(40):
        words = text(60)
        rnd.shuffle(words)
        mixed.append((5000 + i, " ".join(words)))
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd + mixed], "doc_id long, text string, word int")
    got = [r.asDict() for r in pl.score_documents(docs).collect()]
    assert len(got) == len(rows) + len(odd) + len(mixed)
    mean = lambda ids: np.mean([r["mean_log_likelihood"] for r in got if r["doc_id"] in ids])
    assert mean(set(range(800))) > mean({r[0] for r in mixed}) + 0.5  # shuffled words are less likely
    empty = [r for r in got if r["doc_id"] in (9000, 9001, 9002)]
    assert all(r["n_tokens"] == 0 and r["log_likelihood"] == 0 and r["mean_log_likelihood"] is None for r in empty)
    assert all(r["log_likelihood"] < 0 for r in got if r["n_tokens"])
    same = [r["log_likelihood"] for r in got if r["doc_id"] == 9003]
    assert len(same) == 2 and abs(same[0] - same[1]) < 1e-6


def test_counts_cover_all_words_and_empty_table(spark):
    docs = spark.createDataFrame([(" ".join(f"v{i}" for i in range(1500)) + " x" * 70,), ("X",)], "text string")
    counts = pl.count_words(docs).counts
    assert counts.sum() == 1571 and counts.max() == 71 and (counts >= 0).all()
    assert pl.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_unseen_strings_score_below_prose_of_many_words(spark):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    weights = [1 / (i + 20) for i in range(3000)]
    prose = [(i, " ".join(rnd.choices(vocabulary, weights, k=60))) for i in range(600)]
    junk = [(9000 + i, " ".join(f"{rnd.getrandbits(60):x}" for _ in range(60))) for i in range(30)]
    got = {r["doc_id"]: r for r in pl.score_documents(spark.createDataFrame(prose + junk, "doc_id long, text string")).collect()}
    assert len({w for _, text in prose for w in text.split()}) > pl.FREQUENT
    assert max(got[i]["mean_log_likelihood"] for i, _ in junk) < min(got[i]["mean_log_likelihood"] for i, _ in prose)


def test_rare_words_share_their_bucket_by_count(spark):
    """An untrained network predicts about by counts alone, so every text's sum can be told from the words."""
    text = " ".join(f"f{i} " * 8 for i in range(pl.FREQUENT)) + " ".join(f"r{i % 900}" for i in range(1200))
    texts = {1: text, 2: "r1 r1 r899", None: "F3", 3: None}
    docs = spark.createDataFrame([(i, texts[i]) for i in (1, 2, 2, None, 3)], "doc_id long, text string")
    known = pl.count_words(docs.where("text is not null"))
    n = Counter(w for i in (1, 2, 2, None) for w in texts[i].lower().split())
    token = {w: int(known.of(words_of(pa.array([w])).hashes)[0]) for w in n}
    assert all((token[w] < pl.FREQUENT) == w.startswith("f") for w in n)
    share = np.log((known.counts + 1) / (known.counts.sum() + pl.TOKENS))
    inside = {w: np.log((n[w] - pl.DISCOUNT) / known.counts[t]) if t >= pl.FREQUENT else 0 for w, t in token.items()}
    got = pl.score_documents(docs, rounds=0).collect()
    assert len(got) == 5
    for r in got:
        words = (texts[r["doc_id"]] or "").lower().split()
        assert r["n_tokens"] == len(words)
        assert abs(r["log_likelihood"] - sum(share[token[w]] + inside[w] for w in words)) <= 0.3 * len(words)
