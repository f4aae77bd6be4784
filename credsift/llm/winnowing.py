"""Document fingerprints by winnowing, and the likeness of neighbouring and edited texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 8
WINDOW = 16
PLACE_BITS = 31
PLACES = 1 << PLACE_BITS
HASH_MASK = 0x7FFFFFFF80000000


def gram_marks(text: Column, k: int, first: Column | int = 0) -> Column:
    """One long per k-gram: 32 bits of hash above, minus the place.

    The smallest mark is the smallest hash, at its rightmost place.  ``text``
    starts at place ``first`` of a document.  A document shorter than ``k`` is
    one gram; an empty one has none.
    """
    start = first if isinstance(first, Column) else F.lit(first)
    grams = F.when((F.length(text) >= k) | (start > 0), F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)))
    grams = grams.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda gram, i: F.xxhash64(gram).bitwiseAND(F.lit(HASH_MASK)) - (i + start))


def with_window_minima(df: DataFrame, name: str, marks: Column, w: int) -> DataFrame:
    """Adds the minimum of each ``w`` marks from every place on; the last ones span fewer.

    Spans double: the minimum over 2s marks is the lesser of two over s.
    """
    df, span = df.withColumn(name, marks), 1
    while span < w:
        step = min(span, w - span)
        rest = F.slice(name, F.lit(step + 1), F.greatest(F.size(name), F.lit(1)))
        df = df.withColumn(name, F.zip_with(name, rest, lambda a, b: F.least(a, b)))
        span += step
    return df


def mark_hash(mark: Column) -> Column:
    return F.shiftright(mark + F.pmod(-mark, F.lit(PLACES)), PLACE_BITS)


def mark_place(mark: Column) -> Column:
    return F.pmod(-mark, F.lit(PLACES))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def winnow(df: DataFrame, text: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """Adds ``marks`` (all k-grams), ``minima`` (one per window) and ``selected``, the fingerprint.

    Any passage of ``w + k - 1`` code points that two texts share puts a
    common hash into both fingerprints; ``mark_place`` tells where.  Null is
    an empty text, whose fingerprint is empty.
    """
    windows = F.when(F.size("marks") == 0, F.lit(0)).otherwise(F.greatest(F.size("marks") - (w - 1), F.lit(1)))
    marked = df.withColumn("marks", gram_marks(F.coalesce(F.col(text), F.lit("")), k))
    return (
        with_window_minima(marked, "minima", F.col("marks"), w)
        .withColumn("minima", F.slice("minima", F.lit(1), windows))
        .withColumn("selected", F.array_distinct("minima"))
    )


def with_next_text(docs: DataFrame, key: str, text: str, n_ranges: int) -> DataFrame:
    """(range, place, guest, key, text, next_text): next row by ascending key, after the last the first.

    Quantiles of the key cut the rows into ranges.  The row a range starts with
    also goes, as a guest, to the end of the range before, so that each range
    knows its neighbours: the texts are shuffled once and no range is more than
    a share of the rows.  Equal keys are in order of their texts; null keys come first.
    """
    spots = [i / n_ranges for i in range(1, n_ranges)]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts, lowest, any_null = rows.agg(
        F.percentile_approx("key", spots, 10_000), F.min("key"), F.max(F.col("key").isNull())
    ).first()
    starts = sorted({c for c in cuts or [] if c != lowest or any_null})
    kind = rows.schema["key"].dataType
    bounds = F.array(*[F.lit(s).cast(kind) for s in starts]).cast(f"array<{kind.simpleString()}>")
    place = F.size(F.filter(bounds, lambda b: b <= F.col("key")))
    first = F.col("key").isNull() if any_null else F.col("key") == F.lit(lowest).cast(kind)
    home = F.struct(place.alias("range"), F.lit(False).alias("guest"))
    before = F.when(first, F.lit(len(starts))).otherwise(place - 1)
    guest = F.struct(before.alias("range"), F.lit(True).alias("guest"))
    opens = first | F.array_contains(bounds, F.col("key"))
    both = F.explode(F.when(F.coalesce(opens, F.lit(False)), F.array(home, guest)).otherwise(F.array(home)))
    in_order = Window.partitionBy("range").orderBy("guest", "key", "text")
    return (
        rows.select(both.alias("at"), "key", "text").select("at.range", "at.guest", "key", "text")
        .withColumn("next_text", F.coalesce(F.lead("text").over(in_order), F.lit("")))
        .withColumn("place", F.row_number().over(in_order))
    )


def fingerprint_documents(
    docs: DataFrame, k: int = K, w: int = WINDOW, n_ranges: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The edited text has the last quarter of the code points (rounded down)
    replaced by the first as many of the next document's.  K-grams and windows
    that lie wholly before the edit are taken over; the rest is hashed anew.

    Returns key, n_chars, edited_sha256, selected and edited_selected (marks: see
    ``mark_hash`` and ``mark_place``), near_edited and near_next, the likeness
    of the hashes to those of the edited text and of the next document.
    Null is an empty text; the only row of a table is its own neighbour.
    """
    if n_ranges is None:
        n_ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = (
        with_next_text(docs, key, text, n_ranges)
        .withColumn("n_chars", n).withColumn("kept_chars", n - quarter)
        .withColumn("edited", F.concat(F.left("text", F.col("kept_chars")), F.left("next_text", quarter)))
    )
    kept_grams = F.when(F.length("edited") < k, F.lit(0)).otherwise(F.greatest(F.col("kept_chars") - (k - 1), F.lit(0)))
    tail = F.expr("substring(edited, kept_grams + 1, length(edited))")
    total = F.when(F.size("edited_marks") == 0, F.lit(0)).otherwise(F.greatest(F.size("edited_marks") - (w - 1), F.lit(1)))
    hashes = lambda marks: F.array_distinct(F.transform(marks, mark_hash))
    marked = (
        winnow(rows, "text", k, w)
        .withColumn("kept_grams", kept_grams)
        .withColumn("edited_marks", F.concat(F.slice("marks", F.lit(1), F.col("kept_grams")), gram_marks(tail, k, F.col("kept_grams"))))
        .withColumn("kept_windows", F.greatest(F.col("kept_grams") - (w - 1), F.lit(0)))
        .withColumn("n_windows", total)
    )
    after = F.slice("edited_marks", F.col("kept_windows") + 1, F.greatest(F.size("edited_marks"), F.lit(1)))
    return (
        with_window_minima(marked, "edited_minima", after, w)
        .withColumn("edited_minima", F.concat(
            F.slice("minima", F.lit(1), F.col("kept_windows")),
            F.slice("edited_minima", F.lit(1), F.col("n_windows") - F.col("kept_windows")),
        ))
        .withColumn("edited_selected", F.array_distinct("edited_minima"))
        .withColumn("hashes", hashes("selected")).withColumn("edited_hashes", hashes("edited_selected"))
        .select(
            "range", "place", "guest", F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            "selected", "edited_selected", "hashes", likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        )
        .withColumn("next_hashes", F.lead("hashes").over(Window.partitionBy("range").orderBy("place")))
        .where(~F.col("guest"))
        .withColumn("near_next", likeness(F.col("hashes"), F.col("next_hashes")))
        .drop("range", "place", "guest", "hashes", "next_hashes")
    )
