"""URL filter: rules first, then host reputation shrunk from host to domain to suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.session import materialise

#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Bounds of a prior's weight, in labelled pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` and the path up to ``?`` or ``#``; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return lower_ascii(host), F.substring(rest, F.length(host) + 1, F.length(rest) + 1)


def parent_domains(hosts: DataFrame, two_label_suffixes: Sequence[str]) -> DataFrame:
    """Adds ``suffix`` and ``domain`` (registered domain) of ``host``; both empty for an empty host."""
    two = F.substring_index("host", ".", -2)
    suffix = F.when(two.isin(*two_label_suffixes), two).otherwise(F.substring_index("host", ".", -1))
    return hosts.withColumn("suffix", suffix).withColumn(
        "domain", F.expr("substring_index(host, '.', -1 - size(split(suffix, '[.]')))")
    )


def shrunk(counts: DataFrame) -> DataFrame:
    """Adds ``prior`` and ``weight`` of the members of a level.

    Each member comes with the counts and the prior of the one above it
    (``up_n``, ``up_bad``, ``up_prior``, ``up_weight``).  Its own prior is the
    posterior mean of the one above without the member's own outcomes.  The
    weight is fitted to the level by moments: the wider the rates of its members
    spread beyond what chance gives, the less weight.
    """
    mean = (F.col("up_bad") - F.col("bad") + F.col("up_prior") * F.col("up_weight")) / (
        F.col("up_n") - F.col("n") + F.col("up_weight")
    )
    counts = counts.withColumn("prior", mean)
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)
    fit = counts.where("n > 0").agg(
        F.sum("n").cast("double").alias("all"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"),
        F.count(F.lit(1)).alias("members"), F.sum(spread).alias("spread"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("chance"),
    ).first()
    # variance between members = spread beyond sampling noise; weight = mean (1 - mean) / variance - 1
    weight = MOST_WEIGHT
    if fit["members"] and fit["all"]:
        noise = fit["chance"] / fit["all"]
        room = fit["all"] - fit["squares"] / fit["all"]
        between = max(0.0, fit["spread"] - fit["members"] * noise) / room if room > 0 else 0.0
        weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, noise / between - 1.0)) if between > 0 else MOST_WEIGHT
    return counts.withColumn("weight", F.lit(round(weight, 3)))


def host_reputation(outcomes: DataFrame, two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES, z: float = 1.645) -> DataFrame:
    """(host, n, bad) to (host, n, bad, rate, lower): bad rate of every host.

    ``n`` labelled pages, ``bad`` of them bad; hosts without labels have 0 and 0
    and get their domain's rate.  ``lower`` is the lower bound of the posterior
    rate at ``z`` standard deviations, not below 0.
    """
    hosts = materialise(parent_domains(outcomes, two_label_suffixes))
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()

    def total(*by):
        return hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def above(level: DataFrame, *by):
        return materialise(level.select(*by, *(F.col(c).alias(f"up_{c}") for c in ("n", "bad", "prior", "weight"))))

    whole = {"up_n": F.lit(n), "up_bad": F.lit(bad), "up_prior": F.lit(0.5), "up_weight": F.lit(2.0)}
    suffixes = above(shrunk(total("suffix").withColumns(whole)), "suffix")
    domains = above(shrunk(total("suffix", "domain").join(suffixes, "suffix")), "suffix", "domain")
    known = shrunk(hosts.join(domains, ["suffix", "domain"]))
    mass = F.col("n") + F.col("weight")
    rate = (F.col("bad") + F.col("prior") * F.col("weight")) / mass
    lower = F.greatest(F.lit(0.0), F.col("rate") - F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("mass") + 1)))
    return known.withColumn("rate", rate).withColumn("mass", mass).select("host", "n", "bad", "rate", lower.alias("lower"))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host) to (host, rules): the rules of the host and its parents, longest first."""
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    split = rules.select(
        F.substring_index("rule", "/", 1).alias("parent"),
        F.struct(
            F.length("rule").alias("size"), F.col("rule"),
            F.expr("substring(rule, instr(rule, '/'))").alias("path"), F.col("verdict"),
        ).alias("r"),
    )
    return (
        hosts.select("host", F.explode(parents).alias("parent")).join(split, "parent")
        .groupBy("host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("rules"))
    )


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = 0.5,
    z: float = 1.645, key: str = "page_id", url: str = "url",
) -> DataFrame:
    """A verdict for every row of ``pages``.

    ``labels``: (key, n, bad), labelled outcomes of pages.  The longest rule that
    fits host and path decides; without one a page is blocked if its host's bad
    rate lies above ``max_bad`` with the certainty of ``z``.  An empty host has
    no reputation and is allowed unless a rule fits.

    Returns key, host, path, rule, verdict, n_labelled (of the host).  A null
    url, or one without ``://``, has an empty host and path; repeated rows are
    judged each; an empty table gives an empty one.  Rules and reputations are
    worked out per host, so a page costs one join on its host.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    judged = labels.groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    outcomes = parsed.select("key", "host").join(judged, "key", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    known = materialise(host_reputation(outcomes, z=z))
    table = spark.createDataFrame(list(rules), "verdict string, rule string")
    by_host = materialise(
        known.join(rules_of_hosts(known.select("host"), table), "host", "left")
        .select("host", "n", "lower", F.coalesce("rules", F.array()).alias("rules"))
    )
    rule = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    bad_host = (F.col("host") != "") & (F.col("lower") > F.lit(max_bad))
    return (
        parsed.join(by_host, "host").withColumn("r", rule)
        .select(
            F.col("key").alias(key), "host", "path", F.col("r.rule").alias("rule"),
            F.coalesce("r.verdict", F.when(bad_host, "block").otherwise("allow")).alias("verdict"),
            F.col("n").alias("n_labelled"),
        )
    )
