"""LM scoring: pseudo-likelihood of every token under a network that sees both sides of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.llm.words import Words, parts, words_of
from credsift.session import materialise

#: Classes of tokens and tokens per class; the last classes hold hash buckets for rare words.
#: The network predicts the bucket; which word of it stands there is told by the counts of all words.
CLASSES, PER_CLASS, RARE_CLASSES = 32, 32, 8
WIDTH, HIDDEN, BATCH, RATE = 2, 16, 4096, 0.15
#: Passes over disjoint parts of the corpus; the models of all tasks are averaged after each.
ROUNDS = 2
#: What is taken off the count of every rare word, for words that the corpus does not have.
DISCOUNT = 0.5

TOKENS = CLASSES * PER_CLASS
FREQUENT = TOKENS - RARE_CLASSES * PER_CLASS
PAD = TOKENS


@dataclass
class Vocabulary:
    """Hashes of the frequent words, in order of the hash, their tokens, and counts of all tokens."""

    hashes: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        rare = FREQUENT + (hashes % np.uint64(TOKENS - FREQUENT)).astype(np.int64)
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.tokens[at], rare)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): the hash of every distinct word of all texts and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 1 << 23):
                word, n = np.unique(words_of(part.column("text"), fold=True).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return materialise(rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def count_words(rows: DataFrame) -> Vocabulary:
    """Counts every word of every text; the frequent ones become tokens, the others share buckets."""
    return vocabulary_of(word_counts(rows))


def vocabulary_of(counted: DataFrame) -> Vocabulary:
    bucket = F.pmod(F.col("word"), F.lit(TOKENS - FREQUENT))
    frequent = counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    total = counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TOKENS)
    for r in total:
        counts[FREQUENT + r["bucket"]] += r["n"]
    words = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    for token, r in enumerate(frequent):
        counts[token] = r["n"]
        counts[FREQUENT + r["word"] % (TOKENS - FREQUENT)] -= r["n"]
    order = np.argsort(words)
    return Vocabulary(words[order], order, counts)


class Network:
    """Both sides' words, each by the embedding of its place, summed and bent; a class, then a token in it."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat.astype(np.float32)
        at = 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes() -> dict[str, tuple[int, ...]]:
        return {
            "embedding": (2 * WIDTH, TOKENS + 1, HIDDEN), "bend": (HIDDEN,), "to_class": (HIDDEN, CLASSES), "class_bias": (CLASSES,),
            "to_token": (CLASSES, HIDDEN, PER_CLASS), "token_bias": (CLASSES, PER_CLASS),
        }

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes().values())

    @classmethod
    def initial(cls, counts: np.ndarray) -> Network:
        """Small random embeddings; biases that give the counts of the corpus."""
        out = cls(np.random.Generator(np.random.PCG64(5)).normal(0, 0.1, cls.size()))
        share = np.log((counts + 1.0) / (counts.sum() + TOKENS)).reshape(CLASSES, PER_CLASS)
        whole = np.log(np.exp(share).sum(axis=1))
        out.bend[:], out.class_bias[:], out.token_bias[:] = 0, whole, share - whole[:, None]
        return out

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = self.embedding[0][around[:, 0]]
        for j in range(1, 2 * WIDTH):
            state = state + self.embedding[j][around[:, j]]
        state = np.tanh(state + self.bend)
        return state, log_softmax(state @ self.to_class + self.class_bias)

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        state, classes = self.forward(around)
        kind, place = np.divmod(token, PER_CLASS)
        out = classes[np.arange(len(token)), kind]
        for c, rows in by_class(kind):
            inside = log_softmax(state[rows] @ self.to_token[c] + self.token_bias[c])
            out[rows] += inside[np.arange(len(rows)), place[rows]]
        return out

    def gradient(self, around: np.ndarray, token: np.ndarray) -> tuple[float, Network]:
        """Mean loss of a batch and its gradient."""
        n = len(token)
        grad = Network(np.zeros(self.size(), np.float32))
        state, classes = self.forward(around)
        kind, place = np.divmod(token, PER_CLASS)
        loss = -classes[np.arange(n), kind].sum()
        off = np.exp(classes)
        off[np.arange(n), kind] -= 1
        off /= n
        grad.to_class[:], grad.class_bias[:] = state.T @ off, off.sum(axis=0)
        back = off @ self.to_class.T
        for c, rows in by_class(kind):
            inside = log_softmax(state[rows] @ self.to_token[c] + self.token_bias[c])
            at = np.arange(len(rows))
            loss -= inside[at, place[rows]].sum()
            off = np.exp(inside)
            off[at, place[rows]] -= 1
            off /= n
            grad.to_token[c], grad.token_bias[c] = state[rows].T @ off, off.sum(axis=0)
            back[rows] += off @ self.to_token[c].T
        back *= 1 - state * state
        grad.bend[:] = back.sum(axis=0)
        flat, width = back.ravel(), np.arange(HIDDEN)
        for j in range(2 * WIDTH):
            at = (around[:, j, None] * HIDDEN + width).ravel()
            grad.embedding[j] = np.bincount(at, flat, (TOKENS + 1) * HIDDEN).reshape(TOKENS + 1, HIDDEN)
        return float(loss) / n, grad


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def by_class(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if edges[c] < edges[c + 1]:
            yield c, order[edges[c] : edges[c + 1]]


def windows(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, the tokens around each): places outside a text hold PAD."""
    tokens, n = vocabulary.of(words.hashes), len(words.hashes)
    sizes = np.diff(words.offsets)
    first, last = np.repeat(words.offsets[:-1], sizes), np.repeat(words.offsets[1:], sizes)
    at, around = np.arange(n), np.empty((n, 2 * WIDTH), np.int64)
    for j, step in enumerate((*range(-WIDTH, 0), *range(1, WIDTH + 1))):
        there = at + step
        ok = (there >= first) & (there < last)
        around[:, j] = np.where(ok, tokens[np.clip(there, 0, max(0, n - 1))], PAD) if n else PAD
    return tokens, around


def distinct_words(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, how often, offsets of the rows): the distinct words of each row, sorted."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.r_[first, len(row)]).astype(np.int32)
    return hashes[first], times, np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32)


class Trainer:
    """Steps over batches; each parameter's step shrinks with what it has moved."""

    def __init__(self, network: Network) -> None:
        self.network, self.seen = network, 0
        self.moved = np.full(network.size(), 1e-6, np.float32)

    def add(self, tokens: np.ndarray, around: np.ndarray) -> None:
        order = np.random.Generator(np.random.PCG64(len(tokens))).permutation(len(tokens))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            _, grad = self.network.gradient(around[rows], tokens[rows])
            self.moved += grad.flat * grad.flat
            self.network.flat -= RATE * (len(rows) / BATCH) ** 0.5 * grad.flat / np.sqrt(self.moved)
            self.seen += len(rows)


def train(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """One pass over all texts, in ``rounds`` parts by a hash of the text.

    In a part every task starts from the common network and trains on its own
    texts; the networks are then averaged, weighted by the tokens they saw.  Spark
    sums them, parameter by parameter; the driver gets one network's size.
    """
    network = Network.initial(vocabulary.counts)
    for i in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((vocabulary, network.flat))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, flat = shared.value
            trainer = Trainer(Network(flat.copy()))
            for batch in batches:
                for part in parts(batch, "text"):
                    trainer.add(*windows(words_of(part.column("text"), fold=True), known))
            if trainer.seen:
                moved = trainer.network.flat.astype(np.float64) * trainer.seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array([trainer.seen], pa.int64()), pa.array([moved], pa.list_(pa.float64()))], ["seen", "values"]
                )

        mine = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == i)
        sums = (
            mine.mapInArrow(run, "seen long, values array<double>").select("seen", F.posexplode("values").alias("place", "value"))
            .groupBy("place").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).collect()
        )
        if sums:
            flat = np.zeros(network.size())
            for r in sums:
                flat[r["place"]] = r["value"] / r["seen"]
            network = Network(flat)
    return network


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, n_tokens, log_likelihood, mean_log_likelihood) of every row.

    Words are counted and the network is trained over all rows; then every
    token of every text is predicted from the ``WIDTH`` words on either side,
    and the log probabilities are summed.  The network gives a rare word's
    bucket; its share of the bucket, (n - DISCOUNT) / n_bucket, comes from the
    counts of all words, joined to the words of each row.
    Null and empty texts have no tokens, a sum of 0 and a null mean; repeated
    rows get equal scores, and count as often as they stand there.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    texts = docs.select(F.col(text).alias("text")).where("text is not null")
    counted = word_counts(texts)
    vocabulary = vocabulary_of(counted)
    network = train(texts, vocabulary, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        network = Network(flat)
        for batch in batches:
            for part in parts(batch, "text"):
                words = words_of(part.column("text"), fold=True)
                tokens, around = windows(words, known)
                logs = np.zeros(len(tokens))
                for i in range(0, len(tokens), BATCH):
                    logs[i : i + BATCH] = network.log_probabilities(around[i : i + BATCH], tokens[i : i + BATCH])
                rare = tokens >= FREQUENT
                logs[rare] -= np.log(known.counts[tokens[rare]])
                n = np.diff(words.offsets)
                sums = np.r_[0.0, np.cumsum(logs)]
                sums = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
                held, times, offsets = distinct_words(words.hashes[rare], np.repeat(np.arange(len(n)), n)[rare], len(n))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("key"), pa.array(n.astype(np.int64)), pa.array(sums),
                     pa.ListArray.from_arrays(offsets, held.view(np.int64)), pa.ListArray.from_arrays(offsets, times)],
                    ["row", "key", "n_tokens", "log_likelihood", "words", "times"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    # written before it is used twice: a row's number holds for this one table only
    scored = materialise(
        rows.mapInArrow(run, f"row long, key {kind}, n_tokens long, log_likelihood double, words array<long>, times array<int>")
    )
    rare = scored.select("row", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word")
    shares = (
        rare.join(counted, "word").groupBy("row")
        .agg(F.sum(F.col("times") * F.log(F.col("n") - F.lit(DISCOUNT))).alias("inside"))
    )
    whole = scored.join(shares, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("log_likelihood") + F.coalesce("inside", F.lit(0.0))).alias("log_likelihood")
    )
    return whole.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
