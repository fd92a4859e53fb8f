"""Queries on streams: files arrive in three parts by their ids, and the stream is started again for each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.operators import similarity, telemetry
from gleaner.plans.domain import load, made_once
from gleaner.plans.similarity_queries import _PRINTS
from gleaner.sources import exchange
from gleaner.storage import shared_folder
from gleaner.streaming import detectors, scan
from gleaner.streaming.drain import drained_in_parts

REGISTERED: dict = {}


def query(sql: str | None):
    def register(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return register


def _parts(rows, number=3):
    """All rows in parts by id, the lesser ids first."""
    most = rows.agg(F.max("id")).first()[0] or 0
    edges = [most * i // number for i in range(number)] + [most]
    return [rows.filter((F.col("id") > lo) & (F.col("id") <= hi)) for lo, hi in zip([-1, *edges[1:-1]], edges[1:], strict=True)]


@query("SELECT session_id, pixel_hash, min(id) AS first_id, max(id) AS second_id FROM (SELECT * FROM {files} WHERE pixel_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, pixel_hash ORDER BY id) <= 2) GROUP BY 1, 2 HAVING count(*) = 2")
def stream_first_duplicates(spark, d):
    files = load(spark, d, "files").select("id", "session_id", "pixel_hash")
    return drained_in_parts(_parts(files), detectors.first_duplicates, "firsts")


@query("SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM {files} GROUP BY 1 HAVING count(pixel_hash) = count(*)")
def stream_finished_folders(spark, d):
    files = load(spark, d, "files").select("id", "path", "pixel_hash")
    expected = files.groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("pending"))
    return drained_in_parts(_parts(files), lambda stream: detectors.finished_folders(stream, expected), "finished")


def _hashes(batch):
    """The texts of a batch hashed as the catalog's are."""
    prints = similarity.text_hash(batch, "path")
    return batch.withColumn("pixel_hash", F.when(F.col("hashable"), F.md5(F.col("text").cast("binary")))).join(prints, "path", "left")


def _scanned(spark, d):
    def make():
        texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
        found = load(spark, d, "files").select("id", "session_id", "path", "size", "modified_at", F.lit("2024-06-01").alias("scanned_at"), F.col("pixel_hash").isNotNull().alias("hashable")).join(texts, "id")
        base = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
        for part in _parts(found):
            part.drop("id").write.mode("append").parquet(f"{base}/in")
            scan.live_scan(spark.readStream.schema(part.drop("id").schema).parquet(f"{base}/in"), f"{base}/catalog", _hashes).awaitTermination()
        return f"{base}/catalog"

    return scan.catalog(spark, made_once(spark, d, "live-scan", make))


@query(_PRINTS + """, edges AS (SELECT max(id) // 3 AS a, max(id) * 2 // 3 AS b FROM {files}),
arrived AS (SELECT f.*, (CASE WHEN id <= a THEN 0 WHEN id <= b THEN 1 ELSE 2 END) AS part FROM {files} f, edges)
SELECT row_number() OVER (ORDER BY part, f.session_id, f.path) AS id, f.session_id, f.path, f.size, f.modified_at, f.pixel_hash, printf('%016x', p.bits) AS perceptual_hash FROM arrived f LEFT JOIN prints p ON p.doc_id = f.id""")
def live_scan(spark, d):
    return _scanned(spark, d).select("id", "session_id", "path", "size", "modified_at", "pixel_hash", "perceptual_hash")


@query("SELECT run_id, stage, count(*) AS rows, max(files) AS files, sum(queued)::BIGINT AS queued FROM {telemetry} WHERE stage <> '' GROUP BY 1, 2")
def live_telemetry(spark, d):
    """The footer that a stream of telemetry leaves after its last part."""
    rows = load(spark, d, "telemetry").select("run_id", F.col("row_id").alias("id"), "stage", "files", "queued")
    base = f"{shared_folder(spark)}/telemetry-{uuid.uuid4().hex}"
    schema = "run_id long, id long, stage string, files long, queued long"
    for part in _parts(rows):
        part.write.mode("append").parquet(f"{base}/in")
        exchange.live_telemetry(spark.readStream.schema(part.schema).parquet(f"{base}/in"), f"{base}/out", telemetry.totals, schema).awaitTermination()
    return exchange.read_summaries(spark, f"{base}/out/footer", "run_id long, stage string, rows long, files long, queued long")


@query("SELECT count(*) AS rows, sum(files)::BIGINT AS files FROM {telemetry}")
def telemetry_files(spark, d):
    """Telemetry written as a file with its footer, read without it."""
    rows = load(spark, d, "telemetry").select("run_id", "row_id", "stage", "files")
    path = f"{shared_folder(spark)}/telemetry-{uuid.uuid4().hex}"
    exchange.write_telemetry(rows, path, rows.agg(F.sum("files").alias("files")))
    return exchange.read_telemetry(spark, path, "run_id long, row_id long, stage string, files long").agg(F.count("*").alias("rows"), F.sum("files").alias("files"))
