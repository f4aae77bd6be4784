"""Scanning entries as they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from credsift.options import ScanOptions
from credsift.functions.matching import content_hits
from credsift.functions.text import decode_text
from credsift.operators.entries import scannable
from credsift.plans.scan import as_findings, entry_hits, explode_hits
from credsift.rules import DEFAULT_RULES, Rule
from credsift.schemas import FINDING_COLUMNS


def scan_stream(
    entries: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    options: ScanOptions = ScanOptions(),
    remember: str = "1 day",
) -> DataFrame:
    """A stream of findings from a stream of entries.

    Matching is the same stateless expression as in a batch.  The first finding
    of a (repository, rule, mask, path) is passed on; repeats are dropped for as
    long as ``remember`` after it arrived.  Time here is the time of arrival, so
    an old commit is scanned like a new one and nothing is ever too late.  The
    caps belong to one finished scan and do not apply.
    """
    arrived = entries.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    hits = _hits_with_arrival(arrived, rules, options)
    first = hits.dropDuplicatesWithinWatermark(["repo", "rule_id", "masked", "path"])
    return as_findings(first, rules).select("repo", *FINDING_COLUMNS)


def _hits_with_arrival(entries: DataFrame, rules: Sequence[Rule], options: ScanOptions) -> DataFrame:
    kept = scannable(entries, options.max_file_bytes, options.binary_prefix_bytes)
    return explode_hits(kept, content_hits(decode_text(F.col("content")), rules, options), rules, "_arrived")


# Findings are dealt to this many groups of the state by a hash of their key.
GROUPS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = ("repo", "type", "matched_value", "file")
_ORDER = ("entry_seq", "line_idx", "rule_ord", "match_ord")


def write_new_findings(
    entries: DataFrame,
    table_path: str,
    checkpoint: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    options: ScanOptions = ScanOptions(),
    groups: int = GROUPS,
) -> StreamingQuery:
    """Append to a findings table what it does not hold yet, batch by batch, until the input is read.

    The keys of all findings so far are keyed state in RocksDB, for ever: a
    batch looks up its own findings and nothing else, however old the table is.
    A new ``checkpoint`` starts from what the table holds and is a writer with
    folders of its own; a batch that is run again after a failure starts from
    the state before it and replaces what it wrote.  Writers of one table take
    turns: one that goes on does not know what others added since it began.

    Of several new findings of a key in one batch the first in scan order is
    kept.  The state store needs a provider with column families, so the
    session's is set to RocksDB.
    """
    spark = entries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    hits = entry_hits(entries, rules, options)
    when = F.unix_micros("commit_date").alias("commit_date")  # JSON would lose the microseconds
    payload = F.to_json(F.struct(*[when if c == "commit_date" else F.col(c) for c in hits.columns]))
    given = hits.select(
        _group(_digest("repo", "rule_id", "masked", "path"), groups), _digest("repo", "rule_id", "masked", "path").alias("digest"),
        *_ORDER, payload.alias("payload"),
    )
    earlier = _read_if_present(spark, table_path, as_findings(hits, rules).select("repo", *FINDING_COLUMNS))
    initial = None
    if earlier is not None:
        initial = earlier.select(_group(_digest(*_KEY), groups), _digest(*_KEY).alias("digest")).distinct().groupBy("group")
    fresh = given.groupBy("group").transformWithStateInPandas(
        statefulProcessor=KnownFindings(), outputStructType="payload string", outputMode="Append", timeMode="None", initialState=initial
    )
    kinds = ", ".join(f"`{f.name}` {'long' if f.name == 'commit_date' else f.dataType.simpleString()}" for f in hits.schema)
    parsed = fresh.select(F.from_json("payload", kinds).alias("h")).select("h.*")
    found = as_findings(parsed.withColumn("commit_date", F.timestamp_micros("commit_date")), rules).select("repo", *FINDING_COLUMNS)
    writer = sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/writer={writer}/batch_id={batch_id}")

    return (
        found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.array(*columns)), 256)


def _group(digest: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(groups)).cast("int").alias("group")


class KnownFindings(StatefulProcessor):
    """Passes on the rows whose digest is new to the state, the first in order of each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "digest string", "seen boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for digest in initialState["digest"]:
            self.known.updateValue((digest,), (True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first: dict[str, tuple] = {}
        seen: set[str] = set()
        for frame in rows:
            for digest, *order, payload in zip(*(frame[c].tolist() for c in ("digest", *_ORDER, "payload"))):
                if digest in first:
                    first[digest] = min(first[digest], (*order, payload))
                elif digest not in seen:
                    seen.add(digest)
                    if not self.known.containsKey((digest,)):
                        first[digest] = (*order, payload)
        for digest in first:
            self.known.updateValue((digest,), (True,))
        yield pd.DataFrame({"payload": [x[-1] for x in first.values()]}, dtype="object")

    def close(self) -> None:
        pass


def _read_if_present(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    schema = like.schema.add("writer", "string").add("batch_id", "long")
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
