"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from credsift.llm.words import parts, text_bytes

SPACE = "▁"
BLANK, EMPTY = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
NO_PAIR = np.iinfo(np.int64).max
#: Words with more symbols are merged by a heap, whose work does not grow with the square of their length.
LONG_WORD = 256
#: Encoded words that a task remembers; beyond them it starts over.
REMEMBERED = 500_000


@dataclass
class Vocabulary:
    """Pieces of a BPE model, and the table of pairs of symbols that merge."""

    surfaces: list[bytes]
    byte_ids: list[int]
    symbols: dict[str, int]
    ids: np.ndarray  # id of a symbol, -1 if it has none and falls back to bytes
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_merged: np.ndarray
    chars: np.ndarray | None = None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        surfaces, byte_ids, merges, symbols = [], [0] * 256, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                surfaces.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i):
                surfaces.append(b"")
            elif model.is_unknown(i):
                surfaces.append(" ⁇ ".encode())
            elif model.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("pieces that span words are not supported")
                symbols[piece] = i
                surfaces.append(piece.replace(SPACE, " ").encode())
                merges.append((piece, model.get_score(i)))
        ids = list(range(len(surfaces)))
        for piece, _ in merges:
            for char in piece:
                if char not in symbols:
                    symbols[char] = len(ids)
                    ids.append(-1)
        ranks = {s: r for r, s in enumerate(sorted({s for _, s in merges}, reverse=True))}
        pairs = sorted(
            (symbols[p[:i]] << 32 | symbols[p[i:]], ranks[s], symbols[p])
            for p, s in merges for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols
        )
        keys, rank, merged = (np.array(x, np.int64) for x in zip(*pairs))
        return cls(surfaces, byte_ids, symbols, np.array(ids, np.int64), keys, rank, merged)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; NO_PAIR where it does not merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at], NO_PAIR), self.pair_merged[at]

    def char_symbols(self, chars: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 - code point for one that is in no piece."""
        if self.chars is None:
            self.chars = -1 - np.arange(0x110000, dtype=np.int64)
            for piece, symbol in self.symbols.items():
                if len(piece) == 1:
                    self.chars[ord(piece)] = symbol
        return self.chars[chars]

    def expand(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids; a symbol without one becomes the ids of its bytes."""
        ids = np.where(symbols >= 0, self.ids[np.maximum(symbols, 0)], -1)
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, offsets
        char_of = {s: c for c, s in self.symbols.items() if s >= len(self.surfaces)}
        spelled = [[self.byte_ids[b] for b in (chr(-1 - s) if s < 0 else char_of[s]).encode()] for s in symbols[bare].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[bare] = [len(x) for x in spelled]
        places = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=places[1:])
        out = np.repeat(ids, sizes)
        for i, x in zip(places[bare].tolist(), spelled):
            out[i : i + len(x)] = x
        return out, places[offsets]


def merge_words(vocabulary: Vocabulary, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges until no pair is left; word i has symbols[offsets[i]:offsets[i + 1]].

    In each round every word merges its pair of the least rank, the leftmost of
    equal ones; the arrays are compacted, and words without a pair leave.
    """
    n = len(offsets) - 1
    word = np.repeat(np.arange(n), np.diff(offsets))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    long = np.flatnonzero(np.diff(offsets) > LONG_WORD)
    if len(long):
        for w in long:
            merged = merge_long(vocabulary, symbols[offsets[w] : offsets[w + 1]])
            done.append((np.full(len(merged), w), merged))
        keep = ~np.isin(word, long)
        symbols, word = symbols[keep], word[keep]

    def ranks_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(places + 1, len(symbols) - 1)
        rank, merged = vocabulary.pairs(symbols[places], symbols[after])
        return np.where((after > places) & (word[after] == word[places]), rank, NO_PAIR), merged

    rank, into = ranks_of(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(word)])
        over = np.repeat(least == NO_PAIR, sizes)
        if over.any():
            done.append((word[over], symbols[over]))
            live = ~over
            symbols, word, rank, into = symbols[live], word[live], rank[live], into[live]
            if not len(symbols):
                break
            sizes, least = sizes[least != NO_PAIR], least[least != NO_PAIR]
        hits = np.flatnonzero(rank == np.repeat(least, sizes))
        hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # the leftmost of each word
        symbols[hits] = into[hits]
        live = np.ones(len(symbols), bool)
        live[hits + 1] = False
        new = np.cumsum(live) - 1
        symbols, word, rank, into = symbols[live], word[live], rank[live], into[live]
        hits = new[hits]
        touched = np.r_[hits, np.maximum(hits - 1, 0)]
        rank[touched], into[touched] = ranks_of(touched)
    words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
    merged = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    return merged[order], np.searchsorted(words[order], np.arange(n + 1))


def merge_long(vocabulary: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The merges of one word in the same order, from a heap of its pairs."""
    n, now = len(symbols), symbols.tolist()
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank, into = vocabulary.pairs(symbols[:-1], symbols[1:])
    heap = [(r, i, now[i], now[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), into.tolist())) if r != NO_PAIR]
    heapq.heapify(heap)
    table = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in table:
            r, m = vocabulary.pairs(np.array([a]), np.array([b]))
            table[a, b] = int(r[0]), int(m[0])
        return table[a, b]

    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = after[i]
        if now[i] != a or j < 0 or now[j] != b:
            continue
        now[i], now[j], after[i] = merged, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0:
                r, m = pair(now[left], now[right])
                if r != NO_PAIR:
                    heapq.heappush(heap, (r, left, now[left], now[right], m))
    return np.array([s for s in now if s is not None], np.int64)


@dataclass
class Encoder:
    """Encodes batches of texts; remembers the words it has met."""

    vocabulary: Vocabulary
    known: dict[bytes, int] = field(default_factory=dict)
    ids: list[np.ndarray] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words, all starting with the marks of white space."""
        plain = words.to_pylist()
        if len(self.known) + len(plain) > REMEMBERED:
            self.known.clear()
            self.ids.clear()
            self.sizes.clear()
        at = np.fromiter((self.known.get(w, -1) for w in plain), np.int64, len(plain))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            data, offsets = text_bytes(words.take(pa.array(fresh)).cast(pa.large_string()))
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
            chars[chars == 32] = ord(SPACE)
            symbols, offsets = merge_words(self.vocabulary, self.vocabulary.char_symbols(chars), lead[offsets])
            ids, offsets = self.vocabulary.expand(symbols, offsets)
            at[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip([plain[i] for i in fresh], at[fresh].tolist()))
            self.ids.append(ids.astype(np.int32))
            self.sizes.append(np.diff(offsets))
            self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        sizes = self.sizes[0][at]
        starts = np.r_[0, np.cumsum(self.sizes[0])][at]
        offsets = np.r_[0, np.cumsum(sizes)]
        return self.ids[0][np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets

    def batch(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text; null and empty texts have none."""
        texts = pc.replace_substring(valid(texts).cast(pa.large_string()).fill_null(""), SPACE, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(BLANK, texts, EMPTY))
        data, offsets = text_bytes(texts)
        if not len(data):
            return pa.ListArray.from_arrays(np.zeros(len(texts) + 1, np.int32), pa.array([], pa.int32()))
        space = data == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True  # a text's own first word
        edges = np.r_[np.flatnonzero(opens), len(data)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        ids, starts = self.words(coded.dictionary)
        each = pa.ListArray.from_arrays(starts.astype(np.int32), ids)
        lists = each.take(coded.indices)
        per_text = np.searchsorted(edges[:-1], offsets)
        return pa.ListArray.from_arrays(lists.offsets.to_numpy()[per_text].astype(np.int32), lists.values)


def valid(texts: pa.Array) -> pa.Array:
    """The texts, with U+FFFD for each byte that is not UTF-8."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()
        return pa.array([None if x is None else one_by_one(x) for x in raw], pa.large_string())


def decode_batch(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    """Texts of lists of ids: pieces put together, byte pieces as UTF-8, without the leading blank of the first piece."""
    ids = ids.fill_null([]) if ids.null_count else ids
    pieces = pa.array(vocabulary.surfaces, pa.large_binary()).take(ids.flatten())
    sizes = np.r_[0, np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))].astype(np.int64)
    ends = np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))].astype(np.int64)
    edges = sizes[ends]
    buffer = pieces.buffers()[2]
    data = np.frombuffer(buffer, np.uint8, int(sizes[-1])) if sizes[-1] else np.zeros(0, np.uint8)
    has_ids = np.diff(ends) > 0
    opening = ids.flatten().to_numpy(zero_copy_only=False)[ends[:-1][has_ids]]
    opens_blank = np.array([s[:1] == b" " for s in vocabulary.surfaces])
    opens_blank[vocabulary.byte_ids] = False
    lead = edges[:-1][has_ids][opens_blank[opening]]
    kept = np.ones(len(data), bool)
    kept[lead] = False
    edges = edges - np.searchsorted(lead, edges)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(edges), pa.py_buffer(data[kept])])
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([one_by_one(x) for x in raw.to_pylist()], pa.large_string())


def one_by_one(raw: bytes) -> str:
    """UTF-8 in which every byte that starts no whole character becomes U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]
    return "".join(out)


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row of ``docs``.

    ``model`` is the path of a BPE model, read by the driver; the vocabulary is
    a broadcast value of its size.  Texts are cut into words before every run
    of blanks, which no piece spans; each distinct word of a batch is merged
    once.  Null is an empty text and has no ids.  Every row is taken for
    itself: repeated rows repeat, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in parts(batch, "text"):
                ids = encoder.batch(part.column("text"))
                decoded = decode_batch(encoder.vocabulary, ids)
                yield pa.RecordBatch.from_arrays([part.column("key"), ids, decoded.cast(pa.string())], ["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
