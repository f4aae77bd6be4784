"""Session settings and the place for intermediate tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "credsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    The size of a scan task is set in bytes, so the number of tasks grows with
    the data; shuffles carry findings only and are left to adaptive execution.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in local mode gets a folder of its own when none is set.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="credsift-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


# Folders of intermediate tables by session, in the order they were made.
_folders: dict[str, list[str]] = {}
_listed: dict[str, str] = {}


def table_folder(spark: SparkSession, name: str, listed_as: str | None = None) -> str:
    """A new folder for an intermediate table in the shared folder; ``listed_as``: its name in the catalogue."""
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(folder)
    if listed_as:
        _listed[folder] = listed_as
    return folder


def folders_made(spark: SparkSession) -> list[str]:
    """The folders of the intermediate tables that this session has made and not released."""
    return list(_folders.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete intermediate tables that no result still to be computed reads."""
    made = _folders.get(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        if folder in made:  # nothing but tables made here is ever deleted
            made.remove(folder)
            if folder in _listed:
                spark.sql(f"DROP TABLE IF EXISTS {_listed.pop(folder)}")
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder, and go on from that.

    The lineage ends there and lost executors do not matter; unlike a plain
    checkpoint the table is columnar and its size is known, so that a small one
    is broadcast by Spark's own threshold.
    """
    path = table_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
