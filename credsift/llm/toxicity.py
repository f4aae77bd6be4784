"""Toxicity: noisy-channel deobfuscation by a character model, then a score of the restored text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.llm.words import SPACES, carried, parts, text_bytes
from credsift.session import materialise

#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 20_000
#: Features of the classifier at most, and what a feature needs: toxic rows and standard deviations above chance.
MOST_FEATURES, LEAST_ROWS, LEAST_Z, LEAST_WEIGHT = 5000, 4, 4.0, 2.5
#: Words of a text that count at most, the most toxic ones.
TOP_WORDS = 3
#: Stems of words that are features besides the whole word.
STEMS = range(4, 9)
#: Symbols of the character model: word boundary, a to z, any other letter.
SYMBOLS = 28
#: What a sign may stand for; fixed by usage.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
WILD = "*#"
SIGN_COST, WILD_COST, KEEP_RUN_COST, DROP_COST, BREAK_COST = 1.0, 3.0, 1.5, 0.5, 0.5
EDGES = ".,;:!?\"'()[]{}<>«»“”„…"
JOINTS = ".-_*/\\~·,'​‌‍"
SUSPECT = re.compile(r"[^\w]|[0-9_]|(.)\1\1")
LETTERS = re.compile(r"[^\W\d_]+")
#: Tokens that a task remembers; beyond them it starts over.
REMEMBERED = 100_000


def symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27 if char.isalpha() else 0


def character_counts(texts: pa.Array) -> np.ndarray:
    """Counts of three symbols in a row; every text is enclosed in boundaries."""
    data, offsets = text_bytes(texts)
    table = np.zeros(256, np.int64)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[0xC3:0xF5] = 27
    table[0x80:0xC0] = -1  # goes with the byte before
    symbols = np.zeros(len(data) + len(offsets), np.int64)
    symbols[np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = table[data]
    symbols = np.r_[0, symbols[symbols >= 0], 0]
    code = symbols[:-2] * SYMBOLS**2 + symbols[1:-1] * SYMBOLS + symbols[2:]
    return np.bincount(code, minlength=SYMBOLS**3)


def character_model(docs: DataFrame, text: str) -> np.ndarray:
    """-log probabilities of a symbol after two others, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in parts(batch, "text", 1 << 20):
                total += character_counts(part.column("text"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["code", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.full(SYMBOLS**3, 0.1)
    for code, n in rows.collect():  # SYMBOLS ** 3 rows at most
        counts[code] += n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return -np.log(counts / counts.sum(axis=2, keepdims=True))


Option = tuple[str, float]


def lattice(chunks: list[str]) -> list[list[Option]]:
    """Readings of each run of equal signs, with their costs; between chunks a boundary may be read."""
    places: list[list[Option]] = []
    for i, chunk in enumerate(chunks):
        if i:
            places.append([("", 0.0), (" ", BREAK_COST)])
        for sign, run in groupby(chunk):
            n = len(list(run))
            if sign.isalpha():
                readings = [(sign, 0.0)]
            elif sign in WILD:
                readings = [(c, WILD_COST) for c in "abcdefghijklmnopqrstuvwxyz"]
            else:
                readings = [(c, SIGN_COST) for c in SIGNS.get(sign, "")] or [("", DROP_COST)]
            if n == 1:
                places.append(readings)
            else:
                once, twice = (2 * KEEP_RUN_COST, 0.0) if n == 2 else (0.0, KEEP_RUN_COST)
                places.append([(c, w + once) for c, w in readings] + [(c * 2, w + twice) for c, w in readings if c])
    return places


def viterbi(places: list[list[Option]], model: list) -> str:
    """The reading of least cost: of the signs plus of the letters under the character model."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in [*places, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, read) in states.items():
            for letters, extra in options:
                x, y, total = a, b, cost + extra
                for char in letters:
                    s = symbol(char)
                    total += model[x][y][s]
                    x, y = y, s
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, read + letters)
        states = after
    return min(states.values())[1].strip()


def readable(token: str) -> bool:
    return all(c.isalpha() or c in SIGNS or c in WILD for c in token) and any(map(str.isalpha, token))


def restore(token: str, model: list) -> list[str]:
    """The words that a token stands for."""
    token = token.lower()
    if not SUSPECT.search(token):
        return [token]
    bare = token.strip(EDGES) or token
    if not SUSPECT.search(bare):
        return [bare]
    chunks = [c for c in re.split(f"[{re.escape(JOINTS)}]+", bare) if c]
    singles = sum(len(c) == 1 for c in chunks)
    if len(chunks) >= 3 and singles >= len(chunks) - 1 and readable("".join(chunks)):
        whole = viterbi(lattice(["".join(chunks)]), model)
        # also cut into words, and without an article that stood before the spaced word
        return [whole, *viterbi(lattice(chunks), model).split(), *([whole[1:]] if len(whole) > 3 else [])]
    if readable(bare) and (re.search(r"(.)\1\1", bare) or not bare.isalpha()):
        return viterbi(lattice([bare]), model).split()
    words = []
    for chunk in chunks:
        if readable(chunk) and SUSPECT.search(chunk):
            words += viterbi(lattice([chunk]), model).split()
        else:
            words += LETTERS.findall(chunk)
    return words


@dataclass
class Restorer:
    """Words of batches of texts, with obfuscated ones restored; remembers the tokens it has met."""

    model: list
    known: dict[bytes, tuple] = field(default_factory=dict)

    def words(self, token: bytes) -> tuple:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[token] = tuple(restore(token.decode("utf-8", "replace"), self.model))
        return found

    def tokens(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct tokens, their indices in the order of the texts, offsets of the texts).

        Runs of at least three single letters or signs count as one more token.
        """
        data, offsets = text_bytes(texts)
        spaces = np.zeros(256, bool)
        spaces[list(SPACES)] = True
        inside = ~spaces[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[offsets[:-1][np.diff(offsets) > 0]] |= inside[offsets[:-1][np.diff(offsets) > 0]]
        starts = np.flatnonzero(opens)
        place = np.r_[0, np.cumsum(inside)]
        edges = np.r_[place[starts], place[-1]].astype(np.int64)
        tokens = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data[inside]))]
        )
        per_text = np.searchsorted(starts, offsets)
        coded = tokens.dictionary_encode()
        single = np.diff(edges) == 1
        run = single[1:-1] & single[:-2] & single[2:] if len(single) > 2 else np.zeros(0, bool)
        if not run.any():
            return coded.dictionary, coded.indices.to_numpy(), per_text
        ids, extra = coded.indices.to_numpy(), {}
        text_of = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text))
        joined, texts_of = [], []
        for start, stop in _runs(single, text_of):
            joined.append(b".".join(tokens[i].as_py() for i in range(start, stop)))
            texts_of.append(text_of[start])
        at = np.array([extra.setdefault(t, len(coded.dictionary) + len(extra)) for t in joined], np.int64)
        dictionary = pa.concat_arrays([coded.dictionary, pa.array(list(extra), pa.large_binary())])
        places = per_text[np.array(texts_of, np.int64) + 1] if len(at) else np.zeros(0, np.int64)
        ids = np.insert(ids.astype(np.int64), places, at)
        return dictionary, ids, per_text + np.searchsorted(places, per_text, side="right") if len(at) else per_text


def _runs(single: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of at least three single tokens inside one text."""
    edges = np.flatnonzero(np.diff(np.r_[0, single.view(np.int8), 0]))
    for start, stop in edges.reshape(-1, 2).tolist():
        cuts = [start, *(np.flatnonzero(np.diff(text_of[start:stop])) + start + 1).tolist(), stop]
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= 3:
                yield a, b


@dataclass
class Classifier:
    """Evidence of a text: the weights of its most toxic words, put through a logistic curve."""

    weights: dict[str, float]
    slope: float
    shift: float
    model: list

    def weight(self, word: str) -> float:
        found = [self.weights.get(word, 0.0)]
        found += [self.weights.get(word[:n] + "-", 0.0) for n in STEMS if n < len(word)]
        return max(found)

    def evidence(self, weights: Iterable[float]) -> float:
        return math.fsum(sorted(weights, reverse=True)[:TOP_WORDS])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def restored_words(rows: DataFrame, model: np.ndarray, keep: str) -> DataFrame:
    """(keep, words): the distinct restored words of every text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            for part in parts(batch, "text"):
                dictionary, ids, offsets = restorer.tokens(part.column("text"))
                each = [restorer.words(t) for t in dictionary.to_pylist()]
                words = [sorted({w for i in set(ids[a:b].tolist()) for w in each[i]}) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column(keep), pa.array(words, pa.list_(pa.string()))], [keep, "words"])

    kind = rows.schema[keep].dataType.simpleString()
    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, words array<string>")


def evidence_of(words: DataFrame, judge: Classifier) -> DataFrame:
    """(evidence, label) of rows with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge.evidence(map(judge.weight, w)) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label")], ["evidence", "label"])

    return words.select("words", "label").mapInArrow(run, "evidence double, label int")


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a slightly restrained logistic curve, by Newton's method."""
    w, design = np.zeros(2), np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) / max(1, len(y)) + strength * w
        curve = (design * (p * (1 - p))[:, None]).T @ design / max(1, len(y)) + strength * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit_classifier(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text"
) -> Classifier:
    """Learns from at most ``sample_rows`` of ``labels`` (key, label 0 or 1), chosen by a hash of the key.

    The character model counts all of ``docs``.  Features are restored words
    and their stems that stand in toxic rows far more often than chance has it.
    """
    model = character_model(docs, text)
    chosen = materialise(
        labels.where("label is not null and key is not null").groupBy("key").agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    )
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    words = materialise(restored_words(rows.select("label", "text"), model, "label"))
    # copies and most near copies have the same two least hashes; they count once
    least = F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), F.lit(1), F.lit(2))
    apart = materialise(words.withColumn("least", least).dropDuplicates(["label", "least"]).select("label", "words"))
    stems = [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.left(w, F.lit(n)), F.lit("-"))) for n in STEMS]
    toxic, total = apart.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    base = min(max(toxic / max(1, total), 1e-6), 1 - 1e-6)
    feature = apart.select("label", F.explode(F.array_distinct(F.concat("words", *stems))).alias("feature"))
    counts = feature.groupBy("feature").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    z = (F.col("bad") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 1.0)) - math.log(base / (1 - base))
    best = (
        counts.where(f"bad >= {LEAST_ROWS}").where(z >= LEAST_Z).where(odds > LEAST_WEIGHT)
        .orderBy(F.desc(z), "feature").limit(MOST_FEATURES).select("feature", odds.alias("weight"))
    )
    weights = {r["feature"]: r["weight"] for r in best.collect()}  # MOST_FEATURES at most
    raw = Classifier(weights, 1.0, 0.0, [])
    pairs = evidence_of(words, raw).collect()  # two numbers a row, sample_rows at most
    x, y = (np.array(c, float) for c in zip(*pairs)) if pairs else (np.zeros(0), np.zeros(0))
    slope, shift = logistic(x, y) if len(set(y.tolist())) == 2 else (1.0, -3.0)
    return Classifier(weights, slope, shift, model.tolist())


def score_texts(
    docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(key, score, predicted, n_words, *carry) of every row: its whole text, restored, under the classifier.

    Null and empty texts have no evidence and get the score of a text without
    any toxic word.  ``n_words`` counts the distinct toxic words found.  Every
    row is judged by itself; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    there, schema, back = carried(docs, carry)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, weights = shared.value, {}
        restorer = Restorer(judge.model)

        def toxic(token: bytes) -> tuple:
            found = weights.get(token)
            if found is None:
                if len(weights) > REMEMBERED:
                    weights.clear()
                words = restore(token.decode("utf-8", "replace"), judge.model)
                found = weights[token] = tuple((w, judge.weight(w)) for w in words if judge.weight(w) > 0)
            return found

        for batch in batches:
            for part in parts(batch, "text"):
                dictionary, ids, offsets = restorer.tokens(part.column("text"))
                found = [toxic(t) for t in dictionary.to_pylist()]
                hit = np.array([bool(f) for f in found], bool)
                places = np.flatnonzero(hit[ids]) if len(ids) else np.zeros(0, np.int64)
                per_text: dict[int, dict[str, float]] = {}
                for t, i in zip((np.searchsorted(offsets, places, side="right") - 1).tolist(), ids[places].tolist()):
                    per_text.setdefault(t, {}).update(found[i])
                evidence, n_words = np.zeros(len(part)), np.zeros(len(part), np.int32)
                for t, words in per_text.items():
                    evidence[t], n_words[t] = judge.evidence(words.values()), len(words)
                score = judge.score(evidence)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n_words), *part.columns[2:]],
                    ["key", "score", "predicted", "n_words", *part.schema.names[2:]],
                )

    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"key {kind}, score double, predicted int, n_words int{schema}")
    return scored.select(F.col("key").alias(key), "score", "predicted", "n_words", *back)


def held_out(key: Column) -> Column:
    """Every fifth row by crc32 of its key as text; never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
