"""Discovery of image files as rows of the files table, and their idempotent ingest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import IMAGE_SUFFIX
from gleaner.operators import ids

#: The columns of a listing; the content is never read for it.
LISTING = "path string, modificationTime timestamp, length long"


def reachable(folders: list[str]) -> tuple[list[str], list[str]]:
    """Local folders that exist and are no links, and the others; paths with a scheme are left to Spark."""
    ok = [f for f in folders if "://" in f or os.path.isdir(f) and not os.path.islink(f)]
    return ok, [f for f in folders if f not in ok]


def discover(spark: SparkSession, folders: list[str], session: int, scanned_at: str) -> DataFrame:
    """session_id, path, size, modified_at, scanned_at of image files under folders, whatever the case of their suffix."""
    found, _ = reachable(folders)
    if not found:
        return spark.createDataFrame([], "session_id long, path string, size long, modified_at string, scanned_at string")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(found).select("path", "modificationTime", "length")
    return _rows(listing, session, scanned_at)


def discover_stream(spark: SparkSession, folder: str, session: int, scanned_at: str, files_per_batch: int = 128) -> DataFrame:
    """The same as a stream: each file once, files_per_batch at most in a micro-batch."""
    stream = spark.readStream.format("binaryFile").schema(LISTING + ", content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return _rows(stream, session, scanned_at)


def _rows(listing: DataFrame, session: int, scanned_at: str) -> DataFrame:
    images = listing.filter(F.lower("path").rlike(IMAGE_SUFFIX))
    modified = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return images.select(F.lit(session).cast("long").alias("session_id"), F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), modified.alias("modified_at"), F.lit(scanned_at).alias("scanned_at"))


def ingest(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with the found rows whose (session_id, path) is new, as new_rows() gives them."""
    rows = new_rows(files, found)
    defaults = {"status": "active", "hash_algorithm": "xxh128"}
    rows = rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c in files.columns and c not in rows.columns})
    return files.unionByName(rows, allowMissingColumns=True)


def new_rows(files: DataFrame, found: DataFrame) -> DataFrame:
    """The found rows whose (session_id, path) is new, with ids that go on from the largest, without gaps, by session and path.

    Of found rows of one path the least (by its other columns) counts.
    """
    key = ["session_id", "path"]
    rest = [c for c in found.columns if c not in key]
    once = found.groupBy(*key).agg(F.min(F.struct(*rest)).alias("row")).select(*key, "row.*") if rest else found.distinct()
    return ids.with_ids(once.join(files.select(*key), key, "left_anti"), key, files)


def ids_of(files: DataFrame, found: DataFrame) -> DataFrame:
    """session_id, path, id of the found rows in a catalog that has ingested them."""
    key = ["session_id", "path"]
    return found.select(*key).distinct().join(files.select(*key, "id"), key)
