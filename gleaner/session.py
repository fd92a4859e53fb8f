"""Sessions for tests and the benchmark; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(name: str, cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "")
    if root not in known.split(":"):
        os.environ["PYTHONPATH"] = f"{root}:{known}".rstrip(":")  # for Python workers
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
