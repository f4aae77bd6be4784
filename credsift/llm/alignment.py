"""Alignment of two tokenizers over the bytes of the same text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.llm.pieces import BLANK, EMPTY, SPACE
from credsift.llm.words import parts, text_bytes
from credsift.session import materialise

#: Bytes of text that are encoded at a time.
AT_ONCE = 1 << 21
#: Signs before an id in the text of the groups, and a bound of both vocabularies.
SIGNS, MOST_IDS = ("", ",", ";", "|"), 1 << 16
#: How byte-level models cut a text into words.  Fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BLANK = 1 << 15
#: Chunks that a task remembers; beyond them it starts over.
REMEMBERED = 700_000
#: A pair of ids as one number: A's id times this, plus B's id.
PAIR = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible characters of Latin-1 stand for themselves, all other bytes, in
    order, for the characters from U+0100 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Encoders:
    """Both tokenizers in one task, with the bytes of each id."""

    a: Callable[[list[str]], list[list[int]]]
    b: Callable[[list[str]], list[list[int]]]
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    @classmethod
    def load(cls, a_model: bytes, b_model: bytes) -> Encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece

        encode, a_bytes = _byte_level(a_model)
        b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces that span words are not supported")
        b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        return cls(encode, lambda texts: b.encode(texts, num_threads=1), a_bytes, b_bytes)


def _byte_level(model: bytes) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """An encoder for a byte-level BPE model (JSON), and the bytes of its ids.

    Where the merges make ids in order and words are cut by the usual pattern,
    as in most models of this kind, the ids are ranks and the faster of two
    libraries gives the same ones (compared for every code point).  It fails on
    very long runs of white space, so texts with one are left to the other.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(model.decode())
    slow.encode_special_tokens = True
    byte_of = byte_alphabet()
    special = {i for i, t in slow.get_added_tokens_decoder().items() if t.special}
    surfaces = [b"" if i in special else bytes(byte_of[c] for c in slow.id_to_token(i)) for i in range(slow.get_vocab_size())]
    told = json.loads(model)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
    ids = told["model"]["vocab"]
    words = told["pre_tokenizer"] or {}
    if (
        all(ids.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and told["normalizer"] is None
        and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    ):
        import tiktoken

        ranks = {surfaces[i]: i for t, i in ids.items() if i not in special}
        fast = tiktoken.Encoding("bytes", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        blank = re.compile(rf"\s{{{LONG_BLANK}}}")

        def encode(text: str) -> list[int]:
            if len(text) > LONG_BLANK and blank.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        return lambda texts: [encode(t) for t in texts], surfaces
    return lambda texts: [x.ids for x in slow.encode_batch_fast(texts, add_special_tokens=False)], surfaces


def align(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Index behind the last token of each group, in order, on either side.

    ``a_ends`` and ``b_ends`` are the byte places at which tokens end.  The
    common ones are the intersection of the keys of two dictionaries from end
    to index; sorted, they cut both lists.
    """
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Column:
    """Rows of whole numbers, all in one array."""

    def __init__(self) -> None:
        self.values, self.sizes, self.starts = (np.zeros(0, np.int64) for _ in range(3))

    def extend(self, rows: list[list[int]]) -> None:
        sizes = np.array([len(r) for r in rows], np.int64)
        values = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        self.values, self.sizes = np.concatenate([self.values, values]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some rows one after the other, and their number in each."""
        sizes = self.sizes[rows]
        return self.values[_spread(self.starts[rows], sizes)], sizes


class Aligner:
    """Aligns texts chunk by chunk; remembers the chunks it has met.

    A chunk begins at a blank behind a character that is no white space.  No
    token of either side crosses such a place, and none depends on what lies
    beyond it, so a chunk's tokens and groups are worked out once.
    """

    def __init__(self, coders: Encoders) -> None:
        self.coders = coders
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.a_ids, self.b_ids, self.a_cuts, self.b_cuts, self.spelled = (Column() for _ in range(5))

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        """The row of each of some distinct chunks."""
        if len(self.known) + len(chunks) > REMEMBERED:
            self.forget()
        fresh = [c for c in chunks if c not in self.known]
        if fresh:
            texts = [c.decode() for c in fresh]
            # the second side adds a blank of its own, but none to nothing
            of_a, of_b = self.coders.a(texts), self.coders.b([t[1:] or " " for t in texts])
            alone = self.coders.b(["x "])[0][-1:]
            of_b = [ids if c != b" " else alone for c, ids in zip(fresh, of_b)]
            a_bytes, b_bytes = self.coders.a_bytes, self.coders.b_bytes
            a_cuts, b_cuts, spelled = [], [], []
            for chunk, a, b in zip(fresh, of_a, of_b):
                a_parts, b_parts = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
                same = b"".join(a_parts) == chunk == b"".join(b_parts)
                spelled.append([int(same)])
                if not same:
                    cuts = [], []
                elif len(a) == 1 or len(b) == 1:
                    cuts = [len(a)], [len(b)]
                else:
                    cuts = align(list(accumulate(map(len, a_parts))), list(accumulate(map(len, b_parts))))
                a_cuts.append(cuts[0])
                b_cuts.append(cuts[1])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            for column, more in zip((self.a_ids, self.b_ids, self.a_cuts, self.b_cuts, self.spelled), (of_a, of_b, a_cuts, b_cuts, spelled)):
                column.extend(more)
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def batch(self, texts: pa.Array) -> list[pa.Array]:
        """The columns a_ids, b_ids, a_cuts, b_cuts, pairs and pair_counts of some texts."""
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(BLANK, texts, EMPTY))
        data, offsets = text_bytes(texts)
        edges = np.r_[np.flatnonzero(_opens(data, offsets)), len(data)].astype(np.int64)
        bounds = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, bounds).dictionary_encode()
        chunk = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        text = np.searchsorted(offsets, edges[:-1], side="right") - 1
        whole = np.ones(len(texts), bool)
        whole[text[self.spelled.values[chunk] == 0]] = False
        chunk, text = chunk[whole[text]], text[whole[text]]
        first = np.searchsorted(text, np.arange(len(texts) + 1))  # of each text, its first chunk

        def column(of: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            values, sizes = of.take(chunk)
            ends = np.r_[0, np.cumsum(sizes)]
            return values, sizes, ends[first]

        (a, a_sizes, a_from), (b, b_sizes, b_from) = column(self.a_ids), column(self.b_ids)
        (a_cuts, n_cuts, cuts_from), (b_cuts, _, _) = column(self.a_cuts), column(self.b_cuts)
        # a cut counts the tokens of its chunk; before it come those of all chunks so far
        a_cuts += np.repeat(np.cumsum(a_sizes) - a_sizes, n_cuts)
        b_cuts += np.repeat(np.cumsum(b_sizes) - b_sizes, n_cuts)
        linked = a[a_cuts - 1] * PAIR + b[b_cuts - 1]
        owner = np.repeat(np.arange(len(texts)), np.diff(cuts_from))
        pairs, counts, pairs_from = _counted(linked, owner, len(texts))
        int32 = pa.int32()
        return [
            _lists(a, a_from, int32), _lists(b, b_from, int32),
            _lists(a_cuts - a_from[owner], cuts_from, int32), _lists(b_cuts - b_from[owner], cuts_from, int32),
            _lists(pairs, pairs_from, pa.int64()), _lists(counts, pairs_from, int32),
        ]


def _opens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at a text's first byte, and at a blank behind what cannot be the end of white space."""
    opens = data == 32
    spaces = np.zeros(256, bool)
    spaces[[9, 10, 11, 12, 13, 32]] = True
    opens[1:] &= ~spaces[data[:-1]]
    wide = np.flatnonzero(opens)
    wide = wide[(wide >= 3) & (data[wide - 1] >= 0x80)]
    # the last bytes of all white space beyond ASCII: C2 xx, E1 9A xx, E2 80 xx, E2 81 xx, E3 80 xx
    opens[wide[(data[wide - 2] == 0xC2) | (np.isin(data[wide - 3], (0xE1, 0xE2, 0xE3)) & np.isin(data[wide - 2], (0x80, 0x81, 0x9A)))]] = False
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    return opens


def _counted(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each owner in order, how often it has each, and where each owner's begin."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return values[at], np.diff(np.r_[at, len(values)]), np.searchsorted(owner[at], np.arange(n + 1))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def names() -> pa.Array:
    """Decimal names of ids behind each of the signs that may stand before one: none, comma, semicolon, bar."""
    return pa.array([sign + str(i) for i in range(MOST_IDS) for sign in SIGNS], pa.large_string())


def groups_text(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> np.ndarray:
    """Indices into `names` that spell ``a1,a2|b1;a3|b2,b3``, the groups of a text in order."""
    a_starts, b_starts = np.r_[0, a_cuts[:-1]], np.r_[0, b_cuts[:-1]]
    out = np.empty(len(a) + len(b), np.int64)
    # of each side, the tokens of all earlier groups of the other come before
    a_place = np.arange(len(a)) + np.repeat(b_starts, a_cuts - a_starts)
    b_place = np.arange(len(b)) + np.repeat(a_cuts, b_cuts - b_starts)
    out[a_place], out[b_place] = len(SIGNS) * a + 1, len(SIGNS) * b + 1
    out[a_place[a_starts]] += 1
    out[b_place[b_starts]] += 2
    out[0] -= 2
    return out


def _digest(spelled: pa.Array) -> str:
    """SHA-256 of the strings put together: the buffer that holds them."""
    return sha256(spelled.buffers()[2]).hexdigest()


def _summed(batch: pa.RecordBatch, spelled: pa.Array) -> pa.RecordBatch:
    """Numbers of tokens, groups and links, and the digest of the groups, in place of ids and cuts."""
    lists = []
    for name in ("a_ids", "b_ids", "a_cuts", "b_cuts"):
        column = batch.column(name)
        flat, offsets = column.values.to_numpy().astype(np.int64), column.offsets.to_numpy()
        lists.append([flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])])
    sizes = [pa.array([len(x) for x in lists[i]], pa.int64()) for i in (0, 1, 2, 2)]
    digests = [_digest(spelled.take(pa.array(groups_text(*four)))) if len(four[0]) else "" for four in zip(*lists)]
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), batch.column("key"), *sizes, pa.array(digests, pa.string()), batch.column("pairs"), batch.column("pair_counts")],
        names=["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "pair_counts"],
    )


def align_texts(
    docs: DataFrame, a_model: str, b_model: str, key: str = "doc_id", text: str = "text", summed: bool = False
) -> DataFrame:
    """``row, key, a_ids, b_ids, a_cuts, b_cuts, pairs, pair_counts`` of every row of ``docs``.

    Group i takes the tokens of A between ``a_cuts[i - 1]`` (0 for the first)
    and ``a_cuts[i]``, and those of B likewise.  A group's last tokens are
    linked, as only they end together; ``pairs`` are the distinct linked pairs
    of ids, ``pair_counts`` how often the text has each.  ``row`` numbers the
    rows, so repeated ids stay apart.  With ``summed``, ids and cuts are summed
    up where they are made: ``n_a, n_b, n_groups, n_links, groups_sha256`` stand
    in their place.

    ``a_model`` (byte-level BPE, JSON) and ``b_model`` (SentencePiece) are
    paths that the driver reads; each task gets the files' bytes.  Strings of
    special tokens in a text are plain text.  Null and empty texts, and texts
    whose tokens do not spell a blank and the text, have no tokens.
    """
    models = []
    for path in (a_model, b_model):
        with open(path, "rb") as file:
            models.append(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(models))
    rows = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Encoders.load(*shared.value))
        number = TaskContext.get().partitionId() << 40
        spelled = names() if summed else None
        for batch in batches:
            for part in parts(batch, "text", AT_ONCE):
                columns = aligner.batch(readable(part.column("text")))
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(part)), pa.int64()), part.column("key"), *columns],
                    names=["row", "key", "a_ids", "b_ids", "a_cuts", "b_cuts", "pairs", "pair_counts"],
                )
                yield _summed(out, spelled) if summed else out
                number += len(part)

    kind = rows.schema["key"].dataType.simpleString()
    whole = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
    sums = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return rows.mapInArrow(
        run, f"row long, key {kind}, {sums if summed else whole}, pairs array<long>, pair_counts array<int>"
    ).withColumnRenamed("key", key)


def readable(texts: pa.Array) -> pa.Array:
    """The texts; null, or not valid UTF-8, is an empty one."""
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()
        texts = pa.array([None if x is None or x.decode(errors="replace").encode() != x else x.decode() for x in raw], pa.large_string())
    return texts.cast(pa.large_string()).fill_null("")


def links(aligned: DataFrame) -> DataFrame:
    """``row, pair, n``: the distinct pairs of each text."""
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "pair_counts")).alias("_l")).select(
        "row", F.col("_l.pairs").alias("pair"), F.col("_l.pair_counts").cast("long").alias("n")
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, n, best``: how often the corpus links each pair, and whether no pair of the same B id has more."""
    counts = links(aligned).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select("pair", (F.col("pair") / PAIR).cast("long").alias("a_id"), (F.col("pair") % PAIR).alias("b_id"), "n")
    most = counts.groupBy("b_id").agg(F.max("n").alias("_most"))
    return counts.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("_most")).alias("best"))


def link_support(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts with their sums, as written by `align_texts`, with ``n_best`` and ``count_sum``, without its pairs.

    The table of pairs grows with the vocabularies, not the documents; whether
    it is broadcast is left to Spark, which knows its size as it is written.
    """
    counts = materialise(pair_counts(aligned).select("pair", F.col("n").alias("_count"), "best"))
    support = links(aligned).join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("_count")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return aligned.join(support, "row", "left").select(
        "row", key, "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
