"""Outcome of a failed scan as status and message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts in an error message that mean "no such repository".
NOT_FOUND_MARKERS = (
    "repository not found",
    "not found",
    "authentication required",
    "401",
    "404",
    "remote repository is empty",
    "no such host",
    "could not read",
)


def classify_scan_error(message: Column, deadline_exceeded: Column | None = None) -> Column:
    """``struct<status, error>``: 408 on a timeout, 404 if not found or private, else 500."""
    timed_out = message.contains("timeout")
    if deadline_exceeded is not None:
        timed_out = F.coalesce(deadline_exceeded, F.lit(False)) | timed_out
    lowered = F.lower(message)
    missing = reduce(lambda a, b: a | b, [lowered.contains(marker) for marker in NOT_FOUND_MARKERS])

    def outcome(status: int, text: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(text).alias("error"))

    return (
        F.when(timed_out, outcome(408, "scan timeout"))
        .when(missing, outcome(404, "repository not found or private"))
        .otherwise(outcome(500, "internal scan error"))
    )
