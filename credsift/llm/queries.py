"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.llm import (
    alignment, dialogues, identifiers, kdtree, minhash, mixing, pieces, pseudolikelihood, reputation, substrings, toxicity, warc, winnowing,
)
from credsift.session import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.word_count(F.col("text"))).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    classifier = toxicity.fit_classifier(docs, labels.where(~toxicity.held_out(F.col("key"))))
    return toxicity.score_texts(docs, classifier).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_words"
    )


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    answers, others = (warc.read_archives(spark, manifest.where(F.col("series") == s)) for s in ("answers", "others"))
    response = F.col("response")
    return warc.transactions(answers, others).select(
        F.col("page").cast("long").alias("page_id"), response["payload_bytes"].alias("payload_bytes"),
        response["payload_digest"].alias("payload_digest"), response["type"].alias("record_type"),
        F.col("refers_to_page").cast("long").alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"),
    )


@query
def op4_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))
    vectors = (
        table(spark, sf_dir, "embeddings").where(kdtree.finite(F.col("embedding")))
        .select(F.col("vec_id").alias("id"), whole.alias("v"))
    )
    return kdtree.top_k(vectors, vectors.where("id % 50 = 0"), k=5).withColumnRenamed("id", "vec_id")


SQL["op4_kdtree"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_pseudolikelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolikelihood.score_documents(table(spark, sf_dir, "documents"))


@query
def op6_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.lit(1).alias("n"), F.coalesce(bad, F.lit(0)).alias("bad")
    )
    return reputation.filter_urls(table(spark, sf_dir, "pages"), outcomes)


@query
def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(marks: str):
        return F.sha2(F.array_join(F.col(marks).cast("array<string>"), ","), 256)

    return winnowing.fingerprint_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        digest("selected").alias("fingerprint"), digest("edited_selected").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = pieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    models = (public_tokenizers.path(m) for m in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = materialise(alignment.align_texts(table(spark, sf_dir, "documents"), *models, summed=True))
    return alignment.link_support(aligned).drop("row")


@query
def op12_find_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.find_identifiers(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, identifiers.KINDS), F.sha2(identifiers.spans_text(base), 256).alias("base_sha256"),
        identifiers.spans_text(F.col("spans")).alias("spans"),
    )


@query
def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    damaged, copies = dialogues.damage(turns)
    found = dialogues.summarise(dialogues.repair(damaged, copies))
    each = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return each.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# -- SQL ------------------------------------------------------------------------

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_mix_sources"] = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS.format('text')}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat('mix:', doc_id)), 1, 15) AS BIGINT) AS hash FROM documents
), s AS (
  SELECT *, [5, 2, 1][CAST(rank % 3 + 1 AS INT)] AS weight, 2 * source_size AS room FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
    FROM d GROUP BY source)
), budget AS (SELECT 1.5::DOUBLE * sum(size) AS words FROM d
), tried AS (
  -- the level if the k sources that fill up first were full and the others shared what is left
  SELECT k.rank, (words - coalesce(sum(s.room) FILTER (s.room * k.weight < k.room * s.weight OR (s.room * k.weight = k.room * s.weight AND s.rank < k.rank)), 0))
         / sum(s.weight) FILTER (s.room * k.weight > k.room * s.weight OR (s.room * k.weight = k.room * s.weight AND s.rank >= k.rank)) AS level
  FROM s AS k CROSS JOIN s CROSS JOIN budget GROUP BY k.rank, words
), shared AS (SELECT max(level) AS level FROM tried JOIN s USING (rank) WHERE room > level * weight
), t AS (
  SELECT source, rank, source_size, least(CAST(room AS DOUBLE), coalesce(level * weight, room)) AS target FROM s LEFT JOIN shared ON true
), q AS (
  SELECT d.*, t.rank, t.source_size, t.target, sum(size) OVER (
    PARTITION BY t.rank ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS running
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), items AS (
  SELECT *, CAST(pass * source_size + running AS DOUBLE) / target AS finish FROM q CROSS JOIN (SELECT unnest([0, 1]) AS pass)
  WHERE size > 0 AND target > 0
), taken AS (
  SELECT doc_id, count(*) AS copies FROM (
    SELECT *, sum(size) OVER (ORDER BY finish, rank, hash, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS upto FROM items
  ) CROSS JOIN budget WHERE upto <= words GROUP BY doc_id
)
SELECT q.doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken, CAST(coalesce(copies, 0) AS INT) AS copies
FROM q LEFT JOIN taken USING (doc_id)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUPS = "".join(f"|{i:05b}" for i in range(32))
_BITS = "".join(f"|{i:x}{i:04b}" for i in range(16))
SQL["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, payload, array_to_string(list_transform(range(40), lambda i:
         substr('{_BITS}', instr('{_BITS}', '|' || substr(sha1(payload), CAST(i AS INT) + 1, 1)) + 2, 4)), '') AS bits FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('{_BASE32}', CAST((instr('{_GROUPS}', '|' || substr(bits, CAST(i AS INT) * 5 + 1, 5)) - 1) / 6 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS has_request, true AS has_metadata
FROM f
"""

SQL["op8_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(l) >= 5 THEN list_transform(range(len(l) - 4), lambda i: array_to_string(l[i + 1:i + 5], ' '))
    WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.y FROM reach AS r JOIN sides AS e ON e.x = r.y
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id, min(y) = doc_id AS kept
FROM reach JOIN documents ON doc_id = x LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

SQL["op9_remove_repeats"] = f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS l FROM documents
), p AS (SELECT doc_id, l, len(l) AS n, unnest(range(len(l))) AS i FROM w
), k AS (
  SELECT doc_id, i, l[i + 1] AS word, CASE WHEN i + 50 <= n THEN array_to_string(l[i + 1:i + 50], ' ') END AS passage FROM p
), f AS (
  SELECT doc_id, i, word, passage IS NOT NULL AND min(doc_id) OVER (PARTITION BY passage) < doc_id AS again FROM k
), c AS (
  SELECT *, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f
), g AS (SELECT doc_id, sum(gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""


def _reputation_sql(rules: tuple, z: float = 1.645, max_bad: float = 0.5) -> str:
    """Three levels of shrinking, written out; ``labels`` are joined to pages by number."""
    suffix = (
        "CASE WHEN regexp_extract(host, '([^.]*[.][^.]*)$', 1) IN (" + ", ".join(f"'{s}'" for s in reputation.TWO_LABEL_SUFFIXES)
        + ") THEN regexp_extract(host, '([^.]*[.][^.]*)$', 1) ELSE regexp_extract(host, '([^.]*)$', 1) END"
    )
    domain = "array_to_string(string_split(host, '.')[-(1 + len(string_split(suffix, '.'))):], '.')"
    prior = "(up_bad - bad + up_prior * up_weight) / (up_n - n + up_weight)"

    def level(name: str, members: str, keys: str) -> str:
        return f"""{name}_0 AS (SELECT *, {prior} AS prior FROM ({members})),
{name}_1 AS (SELECT sum(n)::DOUBLE AS a, sum(n * n)::DOUBLE AS q, count(*) AS m, sum(n * pow(bad / n - prior, 2)) AS spread,
  sum(n * prior * (1 - prior)) AS chance FROM {name}_0 WHERE n > 0),
{name}_2 AS (SELECT *, CASE WHEN a - q / a > 0 THEN greatest(0.0, spread - m * chance / a) / (a - q / a) ELSE 0.0 END AS between_ FROM {name}_1),
{name} AS (SELECT {keys}, n, bad, prior, round(coalesce((SELECT CASE WHEN between_ > 0
  THEN least({reputation.MOST_WEIGHT}, greatest({reputation.LEAST_WEIGHT}, chance / a / between_ - 1.0)) ELSE {reputation.MOST_WEIGHT} END
  FROM {name}_2), {reputation.MOST_WEIGHT}), 3) AS weight FROM {name}_0)"""

    up = "u.n AS up_n, u.bad AS up_bad, u.prior AS up_prior, u.weight AS up_weight"
    verdict = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in sorted(((v, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules), key=lambda x: -len(x[1] + x[2]))
    )
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages
), page AS (
  SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/]*)', 1)")} AS host, substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), outcome AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT *, {domain} AS domain FROM (SELECT *, {suffix} AS suffix FROM (
    SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM page LEFT JOIN outcome USING (page_id) GROUP BY host))
), {level('suffixes', "SELECT suffix, sum(h.n) AS n, sum(h.bad) AS bad, (SELECT sum(n) FROM h) AS up_n, (SELECT sum(bad) FROM h) AS up_bad, 0.5::DOUBLE AS up_prior, 2.0::DOUBLE AS up_weight FROM h GROUP BY suffix", 'suffix')},
{level('domains', f"SELECT x.*, {up} FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix, domain) AS x JOIN suffixes AS u USING (suffix)", 'suffix, domain')},
{level('hosts', f"SELECT h.*, {up} FROM h JOIN domains AS u USING (suffix, domain)", 'host')},
judged AS (SELECT host, n, (bad + prior * weight) / (n + weight) AS rate, n + weight AS mass FROM hosts
), ruled AS (SELECT *, CASE {verdict} END AS fit FROM page)
SELECT page_id, host, path, regexp_extract(fit, ' (.*)$', 1) AS rule, n AS n_labelled,
       coalesce(regexp_extract(fit, '^([^ ]*)', 1), CASE WHEN host <> '' AND rate - {z} * sqrt(rate * (1 - rate) / (mass + 1)) > {max_bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN judged USING (host)
"""


SQL["op6_filter_urls"] = _reputation_sql(reputation.RULES)
