"""A scan that hashes files as they arrive and commits them to a catalog, batch by batch.

The catalog is a folder of Parquet tables, one for each micro-batch, named by
its number. A batch that runs again after a failure finds only the batches
before its own and writes over what it had written, so it gives the same ids
and commits every file once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner import schemas
from gleaner.sources import files as sources
from gleaner.sources import images

COLUMNS = tuple(c.split()[0] for c in schemas.DDL["files"].split(", "))


def catalog(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame:
    """The files that are committed (by batches below a number); an empty table before the first."""
    try:
        rows = spark.read.schema(schemas.DDL["files"] + ", batch int").parquet(f"{folder.rstrip('/')}/files")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.DDL["files"])
    return (rows if below is None else rows.filter(F.col("batch") < below)).select(*COLUMNS)


def commit(folder: str, hashes: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What a stream of arrivals does with each batch: hash what arrived, and add the files whose session and path are new."""

    def run(batch: DataFrame, number: int) -> None:
        known = catalog(batch.sparkSession, folder, number)
        hashed = hashes(batch)
        fresh = sources.new_rows(known, hashed.select(*[c for c in COLUMNS if c in hashed.columns and c != "id"]))
        kinds = schemas.schema("files")
        rows = fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in COLUMNS])
        rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/files/batch={number}")

    return run


def live_scan(arrivals: DataFrame, folder: str, hashes: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Starts the scan of a stream of arrivals (session_id, path, size, modified_at, scanned_at and what hashes() reads) into the catalog in folder.

    hashes() gives rows with pixel_hash, and perceptual_hash, width and height
    if it has them; where it can't hash a file they are null and the file is
    committed without. The scan takes all that is there and ends; started
    again with the same folder it goes on where it was, even if it was killed.
    """
    writer = arrivals.writeStream.foreachBatch(commit(folder, hashes)).option("checkpointLocation", f"{folder.rstrip('/')}/state")
    return writer.trigger(availableNow=True).start()


def image_hashes(batch: DataFrame) -> DataFrame:
    """hashes() for a stream of image files (sources.discover_stream()): both hashes, width and height of the upright image.

    The paths of a batch go to the driver, which hands them to the image
    source; the stream's option maxFilesPerTrigger bounds them. Files that
    can't be decoded have nulls.
    """
    spark = batch.sparkSession
    paths = [r["path"] for r in batch.select("path").distinct().collect()]
    if not paths:
        return batch.withColumns({c: F.lit(None).cast(t) for c, t in (("pixel_hash", "string"), ("perceptual_hash", "string"), ("width", "int"), ("height", "int"))})
    return batch.join(images.with_hashes(images.read_upright(spark, paths)), "path", "left")


def scan_images(spark: SparkSession, source: str, folder: str, session: int, scanned_at: str, files_per_batch: int = 128) -> StreamingQuery:
    """live_scan() of the image files under source, as they are found."""
    return live_scan(sources.discover_stream(spark, source, session, scanned_at, files_per_batch), folder, image_hashes)
