"""Scalar text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Visible characters at each end of a mask, longest run of stars.
MASK_EDGE = 4
MASK_STARS = 20
MESSAGE_LENGTH = 120


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mask_secret(value: Column) -> Column:
    """All stars up to 8 characters, else 4 characters, at most 20 stars, 4 characters."""
    n = F.length(value)
    hidden = F.least(n - 2 * MASK_EDGE, F.lit(MASK_STARS))
    return F.when(n <= 2 * MASK_EDGE, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(
            F.left(value, F.lit(MASK_EDGE)),
            F.repeat(F.lit("*"), hidden),
            F.right(value, F.lit(MASK_EDGE)),
        )
    )


def truncate_text(value: Column, length: int = MESSAGE_LENGTH) -> Column:
    """The first ``length`` characters and ``...`` when there are more."""
    return F.when(F.length(value) > length, F.concat(F.left(value, F.lit(length)), F.lit("..."))).otherwise(value)


def trim_all(value: Column) -> Column:
    """Without white space (in the Unicode sense) at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def display_url(url: Column) -> Column:
    """Without one trailing ``.git``, then without one trailing ``/``."""
    return F.regexp_replace(F.regexp_replace(url, r"\.git\z", ""), r"/\z", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_ext(path: Column) -> Column:
    """From the last dot of the last path element, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"([.][^./]*)$", 1))


def fold_case(text: Column) -> Column:
    """Lower case in which the letters that a caseless pattern folds to ASCII are ASCII."""
    return F.translate(F.lower(text), "ſ", "s")


def severity_rank(severity: Column) -> Column:
    """0 critical, 1 high, 2 medium; anything else after them."""
    return (
        F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)
    )


def finding_id(*parts: Column) -> Column:
    """The same id for the same finding, whichever task or run computes it."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts]), 256)


def decode_text(content: Column) -> Column:
    """Bytes as text, bytes kept."""
    return content.cast("string")
