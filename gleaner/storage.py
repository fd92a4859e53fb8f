"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing, a local session gets a temporary folder;
    any other session is refused, because its executors could not see one.
    """
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="gleaner-")
    return "file://" + _own_folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go at its end, not when the driver happens to collect its garbage: disk holds those of one run, not of all."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write(df: DataFrame, name: str) -> str:
    """The new Parquet folder in the shared folder that holds df."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again.

    This cuts the lineage so that it survives lost executors, and fixes values
    such as partition numbers that a second evaluation could deal differently.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))
