"""Queries on the import of peers' exports, over documents that are derived from the catalog and written one to a file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.plans.domain import load, made_once
from gleaner.sources import imports
from gleaner.storage import shared_folder

REGISTERED: dict = {}

#: Entries that a document of the queries may have.
MOST = 60


def query(sql: str | None):
    def register(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return register


# Fifty files make a document. Some have a bad name, no files, too many entries, or hashes in capitals.
_DOCUMENTS = """
WITH docs AS (SELECT id // 50 AS k, id, path, size, modified_at, md5(path) AS h FROM {files}),
judged AS (SELECT k, count(*) AS n, CASE WHEN k % 7 = 3 THEN 'invalid_username' WHEN k % 11 = 5 THEN 'missing_files' WHEN k % 13 = 4 AND 2 * count(*) > 60 THEN 'too_many_entries' END AS error,
  count(*) FILTER (id % 9 = 0) AS bad, CASE WHEN k % 13 = 4 THEN 2 ELSE 1 END AS times FROM docs GROUP BY k),
outcomes AS (SELECT k, n, error, CASE WHEN error IS NULL THEN concat('peer', (k % 97)::VARCHAR) END AS username, CASE WHEN error IS NULL THEN (n - bad) * times ELSE 0 END AS entries, CASE WHEN error IS NULL THEN bad * times ELSE 0 END AS skipped FROM judged)"""


def _folder(spark, d):
    def make():
        # The last part of exported_at tells documents apart.
        files = load(spark, d, "files").select(F.floor(F.col("id") / 50).alias("k"), "id", "path", "size", "modified_at", F.md5(F.col("path").cast("binary")).alias("h"))
        entry = F.struct(F.concat(F.lit("r"), F.col("id").cast("string")).alias("remote_id"), F.when(F.col("id") % 9 == 0, F.upper(F.concat(F.lit("x"), "h"))).otherwise(F.col("h")).alias("pixel_hash"), "size", "modified_at", F.regexp_extract("path", "[^/]*$", 0).alias("filename"))
        docs = files.groupBy("k").agg(F.sort_array(F.collect_list(entry)).alias("files"))  # fifty at most
        named = docs.select(
            F.when(F.col("k") % 7 == 3, "no name").otherwise(F.concat(F.lit("peer"), (F.col("k") % 97).cast("string"))).alias("username"), F.format_string("2024-06-01#%012d", "k").alias("exported_at"), F.lit("filename").alias("privacy_level"),
            F.when(F.col("k") % 11 == 5, F.lit(None)).when(F.col("k") % 13 == 4, F.concat("files", "files")).otherwise(F.col("files")).alias("files"),
        )
        base = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
        named.filter("exported_at NOT LIKE '%3'").write.option("maxRecordsPerFile", 1).json(f"{base}/plain")
        named.filter("exported_at LIKE '%3'").write.option("maxRecordsPerFile", 1).option("compression", "gzip").json(f"{base}/packed")
        return base

    return made_once(spark, d, "exports", make)


def _documents(spark, d):
    return imports.read_documents(spark, _folder(spark, d), most_entries=MOST)


@query(_DOCUMENTS + " SELECT error, username, entries, skipped, count(*) AS documents FROM outcomes GROUP BY ALL")
def import_outcomes(spark, d):
    return _documents(spark, d)[0].groupBy("error", "username", "entries", "skipped").agg(F.count("*").alias("documents"))


@query(_DOCUMENTS + """, taken AS (SELECT username, max(k) AS k FROM outcomes WHERE error IS NULL GROUP BY 1)
SELECT t.username, concat('r', d.id::VARCHAR) AS remote_id, d.h AS pixel_hash, d.size FROM docs d JOIN taken t USING (k), range(2) r(copy) WHERE d.id % 9 <> 0 AND (copy = 0 OR k % 13 = 4)
UNION ALL SELECT p.username, f.remote_id, f.pixel_hash, f.size FROM {remote_files} f JOIN {remote_peers} p ON p.id = f.peer_id""")
def import_catalog(spark, d):
    """Peers of the catalog keep what they had; those of the documents get what each exported last."""
    outcomes, entries, _ = _documents(spark, d)
    peers, remote = imports.import_peers(load(spark, d, "remote_peers"), load(spark, d, "remote_files"), outcomes, entries, "2024-06-01")
    return remote.join(peers.select(F.col("id").alias("peer_id"), "username"), "peer_id").select("username", "remote_id", "pixel_hash", "size")
