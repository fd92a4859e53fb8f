"""A walk over folders of a file system that all executors mount, level by level: each level's folders are listed by tasks."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import IMAGE_SUFFIX
from gleaner.storage import written

#: Seconds in which a root folder must answer.
TIMEOUT = 5.0
_FOUND = "kind string, path string, size long, modified double, message string"


def linked(path: str) -> bool:
    """Whether a path is a symbolic link or a junction."""
    state = os.lstat(path)
    return stat.S_ISLNK(state.st_mode) or bool(getattr(state, "st_file_attributes", 0) & 0x400)


def reaches(path: str, seconds: float = TIMEOUT, look=os.stat) -> bool:
    """Whether a path answers in time; the thread of one that hangs is left behind."""
    pool = ThreadPoolExecutor(1)
    try:
        pool.submit(look, path).result(timeout=seconds)
        return True
    except (OSError, TimeoutError):
        return False
    finally:
        pool.shutdown(wait=False)


def listed(folder: str) -> list[tuple]:
    """What lies in a folder: sub-folders that are no links, image files (links to files are followed), and what can't be read."""
    found: list[tuple] = []
    try:
        entries = list(os.scandir(folder))
    except OSError as e:
        return [("error", folder, None, None, str(e))]
    for entry in entries:
        try:
            if entry.is_dir():
                if not linked(entry.path):
                    found.append(("folder", entry.path, None, None, None))
            elif re.search(IMAGE_SUFFIX, entry.name.lower()):
                state = os.stat(entry.path)
                found.append(("file", entry.path, state.st_size, state.st_mtime, None))
        except OSError as e:
            found.append(("error", entry.path, None, None, str(e)))
    return found


def _list_folders(seconds: float | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                if seconds is not None and not reaches(folder, seconds):
                    rows = [("error", folder, None, None, "Folder unreachable, skipping: " + folder)]
                else:
                    rows = listed(folder)
                if rows:
                    yield pd.DataFrame(rows, columns=["kind", "path", "size", "modified", "message"]).astype({"size": "Int64", "modified": "Float64"})

    return run


def walk(spark: SparkSession, folders: list[str], session: int, scanned_at: str, seconds: float = TIMEOUT) -> tuple[DataFrame, DataFrame]:
    """Rows to ingest (session_id, path, size, modified_at, scanned_at) and errors (path, message) under folders.

    A level's folders are dealt to tasks, and what they find is written; the
    next level is the sub-folders found, until there are none. Roots that do
    not answer in time and what can't be read are errors; nothing else stops.
    """
    level = spark.createDataFrame([(f,) for f in dict.fromkeys(folders)], "path string")
    whole, limit = None, seconds
    while True:
        tasks = max(1, min(level.count(), 4 * spark.sparkContext.defaultParallelism)) if whole is None else None
        dealt = level.repartition(tasks) if tasks else level.repartition("path")
        found = written(dealt.mapInPandas(_list_folders(limit), _FOUND), "walk")
        whole = found if whole is None else whole.unionByName(found)
        level, limit = found.filter("kind = 'folder'").select("path"), None
        if level.isEmpty():
            break
    modified = F.date_format(F.timestamp_micros(F.round(F.col("modified") * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    files = whole.filter("kind = 'file'").select(F.lit(session).cast("long").alias("session_id"), "path", "size", modified.alias("modified_at"), F.lit(scanned_at).alias("scanned_at"))
    return files, whole.filter("kind = 'error'").select("path", "message")
