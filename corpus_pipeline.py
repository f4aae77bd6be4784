"""From raw documents to a tokenised mix, stage by stage.

Every stage but the last takes and gives the columns of ``documents``.  A stage's
result is written before the next stage is called: a call deletes the
intermediate tables of the stage before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.llm import minhash, mixing, pieces, substrings, toxicity
from credsift.session import folders_made, materialise, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MODEL = "piece_bpe_32k.model"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By session, the intermediate tables of the stage that was called last.
_inner: dict[str, list[str]] = {}


def stage(work: Stage) -> Stage:
    @wraps(work)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        release(spark, _inner.pop(session, []))
        before = set(folders_made(spark))
        result = work(spark, docs, sf_dir)
        _inner[session] = [f for f in folders_made(spark) if f not in before]
        return result

    return called


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic.  Rows of the held-out fold are never learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    classifier = toxicity.fit_classifier(docs, labels.where(~toxicity.held_out(F.col("key"))))
    return toxicity.score_texts(docs, classifier, carry=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every group of near copies, once; rows without an id stay.

    An id that stands with several texts is judged by each of them.
    """
    known = docs.withColumn("same", F.xxhash64("text"))
    copies = minhash.near_duplicates(known, carry=("same",)).where("not kept and doc_id is not null").select("doc_id", "same").distinct()
    return known.join(materialise(copies), ["doc_id", "same"], "left_anti").dropDuplicates(["doc_id", "same"]).select(*COLUMNS)


@stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that a document of a smaller id has; a document of which nothing is left goes.

    Texts that lose nothing stay as they are; others are their words joined by a blank.
    """
    cleaned = substrings.remove_repeats(docs, carry=("lang", "source"))
    text = F.when(F.col("n_removed") == 0, F.col("original")).otherwise(F.col("kept"))
    return (
        cleaned.where("n_removed = 0 or n_removed < n_words")
        .select("doc_id", text.alias("text"), "lang", "source")
        .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)
    )


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document as often as the mix takes it; documents that it does not take go.

    Rows that are equal in id, text and source are taken as often as the one of them that is taken most.
    """
    known = docs.withColumn("same", F.xxhash64("text"))
    names = ("doc_id", "same", "source")
    taken = (
        mixing.mix_sources(known, mixing.word_count(F.col("text")), carry=("same", "source")).groupBy(*names)
        .agg(F.max("copies").alias("copies")).where("copies > 0").withColumnsRenamed({c: f"taken_{c}" for c in names})
    )
    both = known.join(taken, reduce(and_, (F.col(c).eqNullSafe(F.col(f"taken_{c}")) for c in names)))
    return both.withColumn("pass", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


@stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): every text as ids of the public tokenizer, checked by decoding."""
    import public_tokenizers

    coded = pieces.encode_texts(docs, public_tokenizers.path(MODEL))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeats),
    ("mix", mix),
    ("pieces", tokenise),
]
#: The classifier, the sketches and the tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written, and read again by the next, then deleted."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, work in STAGES[:-1]:
        result = work(spark, docs, sf_dir)
        before = set(folders_made(spark))
        docs = materialise(result)
        release(spark, held)
        held = [f for f in folders_made(spark) if f not in before]
    return STAGES[-1][1](spark, docs, sf_dir)
