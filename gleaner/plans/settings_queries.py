"""Queries on settings, exchange documents, texts for display, and streams in their final state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.operators import config, peers
from gleaner.plans.domain import load
from gleaner.sources import exchange
from gleaner.storage import shared_folder, write
from gleaner.streaming import detectors
from gleaner.streaming.drain import drained

REGISTERED: dict = {}


def query(sql: str | None):
    def register(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return register


@query("SELECT language, theme, max_scan_workers, perf_logging, (SELECT scan_delay_ms FROM {sync_config}) AS scan_delay_ms FROM {app_config}")
def app_settings(spark, d):
    return config.app_settings(load(spark, d, "app_config"), load(spark, d, "sync_config"))


@query("SELECT 'auto' AS language, 'dark' AS theme, 4 AS max_scan_workers, false AS perf_logging, 0 AS scan_delay_ms")
def app_settings_defaults(spark, d):
    return config.app_settings(load(spark, d, "app_config").filter("language = 'none'"), load(spark, d, "sync_config").filter("local_username = ''"))


@query("SELECT local_username, '' AS gdrive_folder_id, export_privacy, sync_enabled FROM {sync_config}")
def sync_settings(spark, d):
    return config.sync_settings(load(spark, d, "sync_config"))


@query("SELECT id, language, 'light' AS theme, 8 AS max_scan_workers, perf_logging FROM {app_config}")
def upsert_settings(spark, d):
    return config.upsert(load(spark, d, "app_config"), "app_config", {"theme": "light", "max_scan_workers": 8, "unknown": 1})


@query("SELECT 1 AS id, 'de' AS language, 'system' AS theme, (SELECT count(*) FROM {nation})::INT AS max_scan_workers, false AS perf_logging")
def insert_settings(spark, d):
    """The first row of settings, whose number of workers is a count of the catalog."""
    none = load(spark, d, "app_config").filter("language = 'none'")
    return config.upsert(none, "app_config", {"language": "de", "max_scan_workers": load(spark, d, "nation").count()})


@query("SELECT id, 'bob' AS local_username, 'abcdefghijklmnopqrstuvwxyz' AS gdrive_folder_id, true AS sync_enabled, 'filename' AS export_privacy, scan_delay_ms FROM {sync_config}")
def save_sync(spark, d):
    return config.save_sync(load(spark, d, "sync_config"), " bob ", "abcdefghijklmnopqrstuvwxyz", "filename")[0].select("id", "local_username", "gdrive_folder_id", "sync_enabled", "export_privacy", "scan_delay_ms")


@query("SELECT pixel_hash, target_peer, status, requested_at FROM {requests} WHERE session_id = 1 AND status IN ('pending', 'approved')")
def outgoing_requests(spark, d):
    return peers.outgoing(load(spark, d, "requests"), 1)


@query("""SELECT 'ann' AS username, concat('ann:', id::VARCHAR) AS remote_id, pixel_hash, size, modified_at, regexp_extract(path, '[^/]*$') AS filename, path
FROM {deep_files} WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL""")
def optimised_export(spark, d):
    """An optimised export, written and read back."""
    path = f"{shared_folder(spark)}/optimised-{uuid.uuid4().hex}"
    exchange.write_optimised(load(spark, d, "deep_files"), 1, "ann", "2024-06-01", path, "full_path", share=0.005)
    return exchange.read_optimised(spark, path, whole_documents=False).select("username", "remote_id", "pixel_hash", "size", "modified_at", "filename", "path")


@query("""
WITH e AS (SELECT array_to_string(parts[1:i], '/') AS root FROM (SELECT string_split(path, '/') AS parts FROM {deep_files}) p, range(1, len(parts)) t(i)),
c AS (SELECT root, count(*) AS times FROM e WHERE length(root) >= 10 GROUP BY 1 HAVING count(*) >= greatest(2, floor(0.005 * (SELECT count(*) FROM {deep_files})))),
r AS (SELECT root, row_number() OVER (ORDER BY length(root) DESC, times DESC, root) AS n FROM c), hit AS (SELECT f.id, min(n) AS n FROM {deep_files} f JOIN r ON n <= 8 AND starts_with(f.path, concat(root, '/')) GROUP BY 1)
SELECT f.id, CASE WHEN r.n IS NULL THEN path ELSE concat('<R', (r.n - 1)::VARCHAR, '>', substr(path, length(root) + 1)) END AS tokenised, path FROM {deep_files} f LEFT JOIN hit USING (id) LEFT JOIN r ON r.n = hit.n""")
def tokenised_paths(spark, d):
    files = load(spark, d, "deep_files")
    roots = [(r["token"], r["root"]) for r in peers.common_roots(files, 0.005).collect()]  # at most peers.MOST_ROOTS
    short = peers.tokenise(files, roots).withColumn("tokenised", F.col("path"))
    return peers.detokenise(short, roots).select("id", "tokenised", "path")


@query("""
SELECT id, CASE WHEN size > 0 THEN round(id * 100.0::DOUBLE / size)::BIGINT ELSE 0 END AS percent, concat(((id % 101))::VARCHAR, '%') AS share_text,
CASE WHEN size IS NULL THEN NULL WHEN size < 1000 THEN size::VARCHAR ELSE concat(((size + 50) // 100 // 10)::VARCHAR, '.', ((size + 50) // 100 % 10)::VARCHAR, 'k') END AS thousands,
CASE WHEN id * 100 < 60000 THEN concat((id // 10)::VARCHAR, '.', (id % 10)::VARCHAR, 's') ELSE concat((id // 600)::VARCHAR, 'm ', ((id % 600 + 5) // 10)::VARCHAR, 's') END AS elapsed,
concat('data:image/jpeg;base64,', to_base64(encode(path))) AS uri FROM {files}""")
def display_texts(spark, d):
    n, i = F.col("size"), F.col("id")
    return load(spark, d, "files").select(
        "id", paths.percent(i, n).alias("percent"), paths.share_text((i % 101) / 100).alias("share_text"), paths.thousands_text(n).alias("thousands"),
        paths.elapsed_text(i * 100).alias("elapsed"), paths.data_uri(F.encode("path", "utf-8")).alias("uri"),
    )


@query("SELECT 'ann' AS username, concat('ann:', id::VARCHAR) AS remote_id, pixel_hash, size, regexp_extract(path, '[^/]*$') AS filename, NULL::VARCHAR AS path FROM {files} WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL")
def export_by_settings(spark, d):
    """An export as the settings have it (user ann, names without paths), written and read back."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    exchange.export_by_settings(load(spark, d, "files"), load(spark, d, "sync_config"), 1, "2024-06-01", path)
    return exchange.read_export(spark, path).select("username", "remote_id", "pixel_hash", "size", "filename", "path")


@query("SELECT count(*) AS entries, count(DISTINCT pixel_hash) AS hashes, count(*) AS named, count(*) AS placed FROM {files} WHERE session_id = 2 AND status = 'active' AND pixel_hash IS NOT NULL")
def export_privacy_levels(spark, d):
    """What each level of privacy tells, counted over a session's entries."""
    files = load(spark, d, "files")
    told = lambda level, c: peers.export_rows(files, 2, "ann", level).agg(F.count(c).alias("n"))
    hashes = peers.export_rows(files, 2, "ann", "hash_only").agg(F.count("*").alias("entries"), F.count_distinct("pixel_hash").alias("hashes"))
    return hashes.join(told("filename", "filename").withColumnRenamed("n", "named"), F.lit(True)).join(told("full_path", "path").withColumnRenamed("n", "placed"), F.lit(True))  # one row each


def _hashed(spark, d):
    """The files as a stream over a written table."""
    files = load(spark, d, "files").select("id", "session_id", "path", "pixel_hash")
    return spark.readStream.schema(files.schema).parquet(write(files, "hashed"))


@query("""SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(pixel_hash) AS done, count(*) AS pending, count(pixel_hash) >= count(*) AS complete
FROM {files} GROUP BY 1 HAVING count(pixel_hash) > 0""")
def stream_folder_progress(spark, d):
    expected = load(spark, d, "files").groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("pending"))
    return drained(detectors.folder_progress(_hashed(spark, d), expected), "folders", "complete")
