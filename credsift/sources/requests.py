"""Scan requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift import schemas
from credsift.functions.text import trim_all

MISSING_URL = "request body must contain repo_url"


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines; a line that is not valid JSON has no URL."""
    return spark.read.schema(schemas.REQUESTS).json(path)


def read_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a URL, trimmed, and those without one, with the reason.

    A blank URL is not missing: it is trimmed and fails the URL check later.
    """
    present = F.col("repo_url").isNotNull() & (F.col("repo_url") != "")
    accepted = df.where(present).withColumn("repo_url", trim_all(F.col("repo_url")))
    rejected = df.where(~present).withColumn("error", F.lit(MISSING_URL))
    return accepted, rejected
