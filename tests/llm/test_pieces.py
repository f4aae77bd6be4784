import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from credsift.llm import pieces  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(MODEL)


def texts():
    rnd = random.Random(8)
    made = ["".join(rnd.choice("ab cdetho in▁ \n\t.,0123ößé日🤗") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    return made + [
        "", " ", "   x  y ", "▁▁a▁b", "日本語テキスト 🤗👍🏽", "a" * 700, "ab" * 400, "<s> </s> <unk> <0x0A>", "\x00 x​",
        "é ﬁ", " " * 40 + "z" + " " * 33, "aaaa bbbb" * 300, "� x", "\r\n", "the " * 5000,
        "".join(rnd.choice("abcdethoin.,0123ößé日🤗") for _ in range(3000)),
    ]


def test_encoding_and_decoding_equal_the_library(library, vocabulary):
    rows = texts()
    ids = pieces.Encoder(vocabulary).batch(pa.array(rows))
    assert ids.to_pylist() == [library.encode(t) for t in rows]
    assert pieces.decode_batch(vocabulary, ids).to_pylist() == [library.decode(x) for x in ids.to_pylist()]


def test_decoding_of_any_ids(library, vocabulary):
    rnd = random.Random(9)
    some = [[rnd.randrange(3, 259) if rnd.random() < 0.5 else rnd.randrange(32_000) for _ in range(rnd.randint(0, 12))] for _ in range(1500)]
    got = pieces.decode_batch(vocabulary, pa.array(some, pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(x) for x in some]


def test_rounds_equal_the_heap(monkeypatch, vocabulary):
    rows = texts()
    once = pieces.Encoder(vocabulary).batch(pa.array(rows)).to_pylist()
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    assert pieces.Encoder(vocabulary).batch(pa.array(rows)).to_pylist() == once
    monkeypatch.setattr(pieces, "LONG_WORD", 10**9)
    short = [t for t in rows if len(t) < 800]
    assert pieces.Encoder(vocabulary).batch(pa.array(short)).to_pylist() == [x for t, x in zip(rows, once) if len(t) < 800]


def test_forgetting_words_changes_nothing(monkeypatch, vocabulary):
    rows = texts()
    want = pieces.Encoder(vocabulary).batch(pa.array(rows)).to_pylist()
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    encoder = pieces.Encoder(vocabulary)
    assert [x for t in rows for x in encoder.batch(pa.array([t])).to_pylist()] == want


def test_rows(spark, library):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (None, ""), (3, "x" * 20_000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encode_texts(docs, MODEL).collect()), key=str)
    assert got == sorted(((i, tuple(library.encode(t or "")), t or "") for i, t in rows), key=str)
    assert pieces.encode_texts(docs.limit(0), MODEL).collect() == []
