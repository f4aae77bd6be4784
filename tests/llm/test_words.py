import random

import numpy as np
import pyarrow as pa
import pytest

from credsift.llm import words
from tests.llm.conftest import WORD, fold

TEXTS = ["", None, " ", "a", "a  b\tc\n", " x", "ÀB b", "same same", "no\x1cbreak here", "é" * 5, "A a", "\x0b\x0c\r"]


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_words_against_a_pattern(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("aB é \t\n") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    got = words.words_of(pa.array(texts, pa.string()), fold=True)
    known = {}
    for i, text in enumerate(texts):
        want = WORD.findall(fold(text or ""))
        mine = got.hashes[got.offsets[i] : got.offsets[i + 1]].tolist()
        assert len(mine) == len(want)
        for word, h in zip(want, mine):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_slices_and_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(TEXTS)], ["id", "text"]).slice(3, 6)
    assert words.words_of(batch.column("text")).offsets[-1] == sum(len(WORD.findall(t or "")) for t in TEXTS[3:9])
    assert [r for p in words.parts(batch, "text", 3) for r in p.column("id").to_pylist()] == list(range(3, 9))


def test_rolling_hashes_are_of_content():
    values = words.mix64(np.array([5, 6, 7, 5, 6, 7, 8], np.uint64))
    at = np.arange(5)
    h = words.rolling(values, at, at + 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert words.rolling(values, np.array([0]), np.array([2]))[0] != h[0]
