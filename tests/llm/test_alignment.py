"""Tokenizer alignment against a plain walk over the byte ends."""

from collections import Counter
from functools import lru_cache
from hashlib import sha256

import pytest

pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from credsift.llm import alignment  # noqa: E402
from credsift.session import materialise  # noqa: E402

MODELS = [public_tokenizers.path(m) for m in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SCHEMA = "doc_id long, text string"


@lru_cache
def _tokenizers():
    first = Tokenizer.from_file(MODELS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=MODELS[1]), {ch: b for b, ch in _alphabet().items()}


def coded(text):
    """[(id, bytes)] of both tokenizers, or None where their bytes are not those of the text."""
    if not text:
        return None
    first, second, letters = _tokenizers()
    a = [(t, bytes(letters[c] for c in first.id_to_token(t))) for t in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for t in second.encode(text):
        piece = second.id_to_piece(t)
        b.append((t, bytes([int(piece[1:-1], 16)]) if second.is_byte(t) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else None


def _alphabet():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def walk(a, b):
    """Groups by two pointers, one byte total on each side."""
    groups, i, j, left, right = [], 0, 0, 0, 0
    ga, gb = [], []
    while i < len(a) or j < len(b):
        if left <= right and i < len(a):
            left += len(a[i][1])
            ga.append(a[i][0])
            i += 1
        else:
            right += len(b[j][1])
            gb.append(b[j][0])
            j += 1
        if left == right:
            groups.append((ga, gb))
            ga, gb = [], []
    return groups


def expected(rows):
    groups = [walk(*c) if (c := coded(t)) else [] for _, t in rows]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc, _), g in zip(rows, groups):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        links = [(a[-1], b[-1]) for a, b in g]
        out.append((
            doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g),
            sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
            sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def found(spark, rows, parts=2):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    table = materialise(alignment.align_texts(docs, *MODELS, summed=True))
    return [tuple(r)[1:] for r in alignment.link_support(table).collect()]


CASES = [
    "the cat sat on the mat", "the cat", "", None, " ", "  ", "a ", "a  ", "a\u00a0 b", "a\u3000 b\u2003 c", "it's we'll  x", "\n x\n  y", "é è ñ ", " leading and  double blanks ", "tab\tand\nnew lines\n\n",
    "Größe, naïve café, ñandú", "日本語のテキスト 混ぜる", "emoji 🙂🙂 family 👩‍👩‍👧", "<|endoftext|> is text, <s> too </s> <unk>",
    "a ▁ mark that B spells as a blank", "<0x41> spelled out", "x" * 3000, "wide" + " " * 40_000 + "gap", "1234567890 " * 50, "\u0000 nul ​ zero width", "ﬁ ligature ①",
    "é decomposed", "the cat sat on the mat",
]


def test_against_walk(spark):
    rows = list(enumerate(CASES))
    assert sorted(found(spark, rows)) == sorted(expected(rows))


def test_repeated_and_null_ids(spark):
    rows = [(1, "one text"), (1, "another text"), (None, "third"), (None, "third"), (2, "one text")]
    assert sorted(found(spark, rows), key=repr) == sorted(expected(rows), key=repr)


def test_cuts_and_pairs(spark):
    text = "unbelievable Wörter"
    row = alignment.align_texts(spark.createDataFrame([(7, text)], SCHEMA), *MODELS).collect()[0]
    a, b = coded(text)
    assert row["a_ids"] == [t for t, _ in a] and row["b_ids"] == [t for t, _ in b]
    assert row["a_cuts"][-1] == len(a) and row["b_cuts"][-1] == len(b)
    for i, j in zip(row["a_cuts"], row["b_cuts"]):
        assert b"".join(x for _, x in a[:i]) == b"".join(x for _, x in b[:j])
    assert sum(row["pair_counts"]) == len(row["a_cuts"])


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "text", "r", 5)], "doc_id long, text string, row string, key int")
    assert alignment.align_texts(docs, *MODELS).count() == 1


def test_not_utf8(spark):
    docs = spark.createDataFrame([(1, "plain")], SCHEMA).unionByName(
        spark.sql("SELECT 2L AS doc_id, cast(x'ff41' AS string) AS text")
    )
    sizes = {r["doc_id"]: len(r["a_ids"]) for r in alignment.align_texts(docs, *MODELS).collect()}
    assert sizes[1] > 0 and sizes[2] == 0
