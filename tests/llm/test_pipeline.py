"""Every stage against a brute-force version, each on what the stage before it left."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from credsift.llm.queries import SQL
from credsift.session import materialise
from tests.llm import test_minhash, test_substrings

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{TABLES}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, TABLES))
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns_of_documents(results):
    for df in results[:-1]:
        assert df.dtypes == results[0].dtypes
    assert len(corpus_pipeline.STAGES) == 5


def test_toxic_documents_go(spark, results):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    before, after = texts(results[0]), texts(results[1])
    assert after.items() <= before.items()
    gone = set(before) - set(after)
    known = [i for i in labels if i in before]
    # some eighty labelled rows teach little; clean documents stay all the same
    assert not [i for i in gone if labels.get(i) == 0]
    assert sum((i in gone) == bool(labels[i]) for i in known) / len(known) > 0.8


def test_one_document_of_each_near_copy_stays(results):
    before, after = texts(results[1]), texts(results[2])
    classes = test_minhash.by_hand(sorted(before.items()))
    assert after == {i: t for i, t in before.items() if classes[i][1] == i}


def test_repeated_passages_go(results):
    before, after = texts(results[2]), texts(results[3])
    want = {}
    for i, n_words, n_removed, kept in test_substrings.by_hand(sorted(before.items()), 50):
        if n_removed == 0:
            want[i] = before[i]
        elif n_removed < n_words:
            want[i] = kept
    assert after == want
    assert all(r["n_chars"] == len(r["text"]) for r in results[3].collect())


def test_mix_repeats_as_often_as_its_sql_says(tmp_path, results):
    results[3].toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(tmp_path) / 'documents.parquet'}'")
    result = con.execute(SQL["op1_mix_sources"])
    names = [c[0] for c in result.description]
    want = {row[names.index("doc_id")]: row[names.index("copies")] for row in result.fetchall()}
    assert Counter(r["doc_id"] for r in results[4].collect()) == Counter({i: n for i, n in want.items() if n})
    assert texts(results[4]).items() <= texts(results[3]).items()


def test_pieces_are_the_library_s(results):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    known = {i: library.encode(t) for i, t in texts(results[4]).items()}
    rows = results[5].collect()
    assert len(rows) == results[4].count()
    assert all(list(r["ids"]) == known[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table pass every stage."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality long, toxic long")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (2, None, None, None, None), (None, "", None, "b", 0),
            (3, "w " * 3000, "en", None, 6000), (4, "one two three", None, "a", 13)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, str(tmp_path)))
        assert {r["doc_id"] for r in docs.collect()} <= {1, 3} and (docs.count() > 0) == bool(given)


def test_one_id_with_several_texts(spark, tmp_path):
    """Near copies and the mix judge rows: a text neither goes with its namesake nor is repeated like it."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, "x y z", "en", "t", 5), (3, "", "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, a), (2, b), (3, ""), (3, "x y z")]
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()
    assert not [r for r in mixed if not r["text"]] and {r["text"] for r in mixed} >= {a, b}
