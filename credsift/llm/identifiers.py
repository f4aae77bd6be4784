"""Personal identifiers by bootstrapped contextual extraction.

Identifiers of a fixed form are the seeds.  The words around them are lexical
patterns; patterns and the values that stand in them form a graph of two
sides, which is scored in rounds: a pattern by the share of its values that
are known to be of a kind, an unknown value by the patterns it stands in.
Values that patterns of high confidence agree on are identifiers as well,
though no fixed form knows them.

All of it is built-in expressions.  Texts are read once and never shuffled;
what moves are the marks in them: places, values and the words beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsift.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Not yet an identifier: anything with a digit or a mail sign that no fixed form took.
OTHER = "other"

# Fixed forms.  They take what the plain forms of the docstring of `marks` take,
# written so that no text makes them try a run of characters again from each place in it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# Forms of unknown values: mail addresses without a domain or spelled out, numbers with
# separators, hexadecimal groups, and any other word with a digit.
_LOCAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
_MAIL_LIKE = rf"{_LOCAL}(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)*+"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])"
_NUMBER = r"(?:\([0-9]++\) ?)?[0-9]++(?![A-Za-z])(?:[ ().:/-]{1,2}[0-9]++(?![A-Za-z]))*+"
_WORD = r"[A-Za-z]*+[0-9][0-9A-Za-z]*+"
UNKNOWN = rf"(?<![0-9A-Za-z])(?:{_MAIL_LIKE}|{_GROUPS}|{_NUMBER}|{_WORD})"

FORMS = {
    "email": (EMAIL, "@"),
    "ip": (IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (CARD, r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": (PHONE, r"\+[0-9]"),
    OTHER: (UNKNOWN, r"[0-9@]|[\[(]at[\])]"),
}

#: Code points on each side of a mark in which its context is looked for.
REACH = 80
ROUNDS = 3
#: A pattern's confidence is the share of known values among its own and this many doubtful ones.
DOUBT = 2.0
#: Least confidence of a pattern that may vouch for a value, and least score of a value that is taken.
CONFIDENT, ACCEPTED = 0.6, 0.6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The check digit of a string of decimal digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def well_formed(kind: Column, value: Column) -> Column:
    """Whether a match of a fixed form is an identifier: ranges, digits, check digit."""
    n = F.length(_digits(value))
    small = value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", n.between(13, 19) & passes_luhn(_digits(value)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def may_be(value: Column) -> Column:
    """The kinds an unknown value can be of, by its shape."""
    n = F.length(_digits(value))
    mail = value.rlike(r"@|[\[(]at[\])]")
    whole_number = value.rlike(r"^[0-9 ().:/-]+$")
    kinds = F.array(
        F.when(mail, "email"),
        F.when(value.rlike(r"^[0-9A-Fa-f]+([.:]+[0-9A-Fa-f]+){3,7}$"), "ip"),
        F.when(whole_number & n.between(12, 19) & ~value.rlike("[.:/()]"), "card"),
        F.when(whole_number & n.between(7, 15) & ~value.rlike("[:/]"), "phone"),
    )
    return F.array_compact(kinds)


def _context(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]", "0")


def _matches(text: Column, kind: str) -> Column:
    """``array<struct<kind, size, value, w1, w2, nth>>``: ``size`` counts from the end of the match before."""
    form, gate = FORMS[kind]
    pieces = F.regexp_extract_all(text, F.lit(r"\G(?s:.*?)" + form), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(form), F.lit(0))

    def mark(at: Column) -> Column:
        p, v, i = at["p"], at["v"], at["i"]
        before = F.substring(p, -(F.length(v) + REACH), F.lit(REACH))
        return F.struct(
            F.lit(kind).alias("kind"), F.length(p).cast("long").alias("size"), v.alias("value"),
            _context(F.regexp_extract(before, r"(?:(?:^|\s)(\S+))?\s+$", 1)).alias("w1"),
            _context(F.regexp_extract(before, r"(?:^|\s)(\S+)\s+\S+\s+$", 1)).alias("w2"),
            i.alias("nth"),
        )

    both = F.zip_with(pieces, values, lambda p, v: F.struct(p.alias("p"), v.alias("v")))
    numbered = F.transform(both, lambda b, i: F.struct(b["p"].alias("p"), b["v"].alias("v"), i.alias("i")))
    return F.when(text.rlike(gate), F.transform(numbered, mark))


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, marks): ``row, key`` of every document; ``row, kind, start, stop, value, w1, w2, base`` of every mark.

    The fixed forms, leftmost and without overlap for each kind: email
    ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four numbers of at
    most 255; card ``[0-9]([ -]?[0-9])+`` of 13 to 19 digits with a right check
    digit; phone ``\\+[0-9][ ().0-9-]+[0-9]`` of 9 to 15 digits.  Marks of the
    kind "other" are unknown values that overlap no identifier.  ``start`` and
    ``stop`` count code points; ``w1`` is the word before, ``w2`` the one
    before that.  Null is an empty text.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.concat(*[F.coalesce(_matches(F.col(text), k), F.array().cast(_MARKS)) for k in FORMS]).alias("found"),
    )
    rows = materialise(rows)
    each = rows.select("row", F.explode("found").alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("nth")
    placed = (
        each.withColumn("stop", F.sum("size").over(order))
        .withColumn("start", F.col("stop") - F.length("value"))
        .withColumn("base", well_formed(F.col("kind"), F.col("value")))
        .where(F.col("base") | (F.col("kind") == OTHER))
    )
    so_far = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("base"), F.col("stop"))).over(so_far)
    following = F.min(F.when(F.col("base"), F.col("start"))).over(from_here)
    free = F.coalesce(last <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("stop"), F.lit(True))
    found = placed.withColumn("_free", free).where(F.col("base") | F.col("_free"))
    return rows.select("row", F.col("key").alias(key)), found.select(
        "row", "kind", "start", "stop", "value", "w1", "w2", "base"
    )


_MARKS = "array<struct<kind: string, size: bigint, value: string, w1: string, w2: string, nth: int>>"


def graph(found: DataFrame) -> DataFrame:
    """``pattern, value, seed``: each value once per pattern it stands in; ``seed`` is its kind if it is an identifier."""
    one, two = F.col("w1"), F.concat_ws(" ", "w2", "w1")
    patterns = F.array_compact(F.array(F.when(one != "", one), F.when((one != "") & (F.col("w2") != ""), two)))
    return (
        found.select(F.explode(patterns).alias("pattern"), F.lower("value").alias("value"), F.when(F.col("base"), F.col("kind")).alias("seed"))
        .groupBy("pattern", "value").agg(F.min("seed").alias("seed"))
    )


def pattern_confidence(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """``pattern, kind, confidence``: known values of the kind, by their score, among all values of the pattern."""
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"))
    known = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("_known"))
    return known.join(sizes, "pattern").select("pattern", "kind", (F.col("_known") / (F.col("_n") + DOUBT)).alias("confidence"))


def value_scores(edges: DataFrame, confidence: DataFrame) -> DataFrame:
    """``value, kind, score`` of unknown values: the best kind that confident patterns and the value's shape agree on."""
    vouching = confidence.where(F.col("confidence") >= CONFIDENT)
    unknown = edges.where("seed is null").select("pattern", "value", may_be(F.col("value")).alias("_kinds"))
    voted = (
        unknown.where(F.size("_kinds") > 0).join(vouching, "pattern").where(F.array_contains("_kinds", F.col("kind")))
        .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
    )
    best = F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("_b")
    return voted.groupBy("value").agg(best).select("value", "_b.kind", "_b.score").where(F.col("score") >= ACCEPTED)


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``value, kind, score`` of the values that the patterns around identifiers disclose."""
    edges = materialise(graph(found))
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, news = seeds, None
    for _ in range(rounds):
        news = value_scores(edges, pattern_confidence(edges, scores))
        scores = seeds.unionByName(news)
    return news


def find_identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``row, key, spans`` of every row of ``docs``.

    ``spans`` is ``array<struct<ord, start, stop, kind, value, base, score>>`` by kind
    (in the order of `KINDS`) and place: identifiers of a fixed form (``base``)
    and those that their context disclosed.  ``row`` numbers the rows, so rows
    of one id stay apart.  Null and empty texts have no spans; an empty table
    gives an empty one.  A text's marks are one array, bounded by its length.
    """
    rows, found = marks(docs, key, text)
    found = materialise(found)
    news = discover(found, rounds).withColumnRenamed("kind", "_kind")
    base = found.where("base").select("row", "kind", "start", "stop", "value", "base", F.lit(1.0).alias("score"))
    more = (
        found.where(~F.col("base")).withColumn("_value", F.lower("value")).join(news.withColumnRenamed("value", "_value"), "_value")
        .select("row", F.col("_kind").alias("kind"), "start", "stop", "value", "base", "score")
    )
    place = reduce(lambda rest, k: F.when(F.col("kind") == k[1], k[0]).otherwise(rest), enumerate(KINDS), F.lit(len(KINDS)))
    spans = base.unionByName(more).withColumn("ord", place).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("ord", "start", "stop", "kind", "value", "base", "score"))).alias("spans")
    )
    nothing = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, "row", "left").select("row", key, F.coalesce("spans", nothing).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
