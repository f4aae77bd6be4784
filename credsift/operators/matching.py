"""Rule matching over tables of lines and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.functions.filters import false_positive_line, is_placeholder, within_line_length
from credsift.functions.matching import may_match, redact_text, rule_matches
from credsift.functions.text import fold_case
from credsift.options import ScanOptions
from credsift.rules import DEFAULT_RULES, Rule
from credsift.session import materialise


def rule_value(rules: Sequence[Rule], field: str, rule_ord: Column) -> Column:
    """A field of the rule with the given position; the array is a constant."""
    return F.get(F.array(*[F.lit(getattr(rule, field)) for rule in rules]), rule_ord)


def prefilter(df: DataFrame, text_col: str, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Only the rows whose text may hold a match; never drops one that does."""
    return df.where(may_match(F.col(text_col), rules))


def keep_lines(lines: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Without long lines and lines that look like code or examples."""
    return lines.where(
        within_line_length(F.col("line"), options.max_line_bytes)
        & ~false_positive_line(F.col("line"), options.line_filter)
    )


def match_rules(lines: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, anchored: bool = True) -> DataFrame:
    """One row per match on each line, with ``rule_ord, rule_id, severity, match_ord, raw``.

    ``anchored=False`` tries every pattern on every line; the result is the same.
    """
    if anchored:
        lines = prefilter(lines, "line", rules)
    else:
        rules = tuple(Rule(r.rule_id, r.severity, r.pattern, r.description, (), r.shipped) for r in rules)
    # a pattern that matches the empty string does so at every place: those go before they are rows
    matches = F.filter(rule_matches(F.col("line"), rules), lambda m: F.length(m["raw"]) > 0)
    found = lines.select("*", F.explode(matches).alias("_m"))
    return found.select(
        *lines.columns,
        F.col("_m.rule_ord").alias("rule_ord"),
        rule_value(rules, "rule_id", F.col("_m.rule_ord")).alias("rule_id"),
        rule_value(rules, "severity", F.col("_m.rule_ord")).alias("severity"),
        F.col("_m.match_ord").alias("match_ord"),
        F.col("_m.raw").alias("raw"),
    )


# Length of the anchor starts that lines and rules are joined on.
ANCHOR_START = 3


def match_rules_join(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Matching against rules that are data: rows of a rules table, of any number.

    An equi-join brings a line and a rule together: the distinct three-character
    pieces of the line on one side, the first three characters of each anchor on
    the other.  Of the anchors of a rule that a line holds, the first one makes
    the pair, so no pair comes twice.  A rule without anchors, or with one that
    is shorter, stands under the empty piece, which every line has.  Whether the
    rules are broadcast is left to Spark, so they are written first: of a table
    whose size it does not know, it deals every piece with its line to tasks.
    """
    folded = F.transform(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: F.lower(a))
    usable = (F.size("_anchors") > 0) & F.forall("_anchors", lambda a: F.length(a) >= ANCHOR_START)
    by_start = (
        rules.withColumn("_anchors", folded)
        .withColumn("_anchor", F.explode(F.when(usable, F.col("_anchors")).otherwise(F.array(F.lit("")))))
        .withColumn("_start", F.substring("_anchor", 1, ANCHOR_START))
    )
    by_start = materialise(by_start)
    pieces = F.regexp_extract_all("_folded", F.lit(f"(?s)(?=(.{{{ANCHOR_START}}}))"), F.lit(1))
    held = F.get(F.filter("_anchors", lambda a: F.col("_folded").contains(a)), F.lit(0))
    met = (
        lines.withColumn("_folded", fold_case(F.col("line")))
        .select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), pieces))).alias("_start"))
        .join(by_start, "_start")
        .where((F.col("_anchor") == "") | (held == F.col("_anchor")))
    )
    found = met.select(
        *lines.columns, "rule_ord", "rule_id", "severity",
        F.posexplode(F.regexp_extract_all("line", F.col("regex"), F.col("grp"))).alias("match_ord", "raw"),
    )
    return found.where(F.length("raw") > 0)


def drop_placeholders(matches: DataFrame) -> DataFrame:
    return matches.where(~is_placeholder(F.col("raw")))


def rule_hits(matches: DataFrame) -> DataFrame:
    """Matches and distinct values per rule."""
    return matches.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("raw").alias("distinct_values")
    )


def redact(df: DataFrame, text_col: str, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """``df`` with every secret in ``text_col`` masked."""
    return df.withColumn(text_col, redact_text(F.col(text_col), rules))
