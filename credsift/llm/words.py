"""Words of a batch of texts as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are hashed at a time.
BLOCK = (1 << 21) - 64
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x *= MIX_1
    x ^= x >> np.uint64(33)
    x *= MIX_2
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=None)
def seeds(name: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(name)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to size - 1 of an odd base and of its inverse, modulo 2**64."""
    def row(b: int) -> np.ndarray:
        out = np.full(size, np.uint64(b), np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return row(base), row(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << max(12, (size - 1).bit_length()))
    return up[:size], down[:size]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, name: int = 7) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal slices have equal hashes."""
    base = int(seeds(name, 1)[0]) | 5
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX_1)


@dataclass
class Words:
    """Hashes of all words; row i of the batch has words[offsets[i]:offsets[i + 1]]."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray  # byte places in the batch's text
    ends: np.ndarray
    data: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows) of a string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end behind white space."""
    at, n = 0, len(space)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            back = np.flatnonzero(space[at:to])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                ahead = to + BLOCK
                while ahead < n and not space[to:ahead].any():
                    ahead += BLOCK
                rest = np.flatnonzero(space[to:ahead])
                to = to + int(rest[0]) + 1 if len(rest) else n
        yield at, to
        at = to


def words_of(texts: pa.Array, fold: bool = False) -> Words:
    """Words between ASCII white space; ``fold`` lower-cases A to Z first."""
    data, offsets = text_bytes(texts)
    spaces = np.zeros(256, bool)
    spaces[list(SPACES)] = True
    letters = np.arange(256)
    if fold:
        letters[65:91] += 32
    table = seeds(1, 256)[letters]
    space = spaces[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~space
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    before[:-1] = space[1:]
    before[-1:] = True
    ends = np.flatnonzero(inside & (before | edge[1:])) + 1
    del before, inside, edge
    hashes = np.empty(len(starts), np.uint64)
    for lo, hi in _blocks(space):
        a, b = np.searchsorted(starts, (lo, hi))
        if a < b:
            hashes[a:b] = rolling(table[data[lo:hi]], starts[a:b] - lo, ends[a:b] - lo, 2)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def parts(batch: pa.RecordBatch, text: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        used = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, used + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def carried(docs: DataFrame, carry: Sequence[str]) -> tuple[list[Column], str, list[Column]]:
    """Columns that go along under names of their own: on the way in, as a schema, and on the way out."""
    there = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    schema = "".join(f", carried_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return there, schema, [F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)]
