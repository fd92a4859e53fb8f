"""A catalog of files, decisions, peers and telemetry derived from the supplied tables.

Each table is one SQL text that Spark and DuckDB both run; {name} stands for a
supplied table or another of these.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.storage import write

SUPPLIED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_DAY = "concat('2024-', lpad(cast({0} % 12 + 1 AS STRING), 2, '0'), '-', lpad(cast({0} % 28 + 1 AS STRING), 2, '0'))"

SQL = {
    "files": f"""
SELECT doc_id AS id, cast(CASE WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS BIGINT) AS session_id,
       concat('/', lang, '/', source, '/doc_', cast(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.heic' ELSE '.jpeg' END) AS path,
       CASE WHEN doc_id % 31 <> 0 THEN n_chars END AS size,
       CASE WHEN doc_id % 29 <> 0 THEN {_DAY.format("doc_id")} END AS modified_at,
       CASE WHEN doc_id % 23 <> 0 THEN md5(text) END AS pixel_hash, 'xxh128' AS hash_algorithm,
       CASE WHEN doc_id % 3 = 0 THEN concat('/thumbs/', md5(text), '.jpg') END AS thumbnail_path,
       CASE WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status,
       CASE WHEN doc_id % 13 <> 0 THEN cast(doc_id * 37 % 4000 AS INT) END AS width,
       CASE WHEN doc_id % 13 <> 0 THEN cast(doc_id * 53 % 3000 AS INT) END AS height
FROM {{documents}}""",
    # Longer paths, whose roots stand for many of them.
    "deep_files": """
SELECT id, session_id, concat('/home/', CASE session_id WHEN 1 THEN 'ann' ELSE 'bob' END, '/pictures', path) AS path, size, modified_at, pixel_hash, status FROM {files}""",
    # A folder for each hash: all files of a duplicate group lie in one folder, a lone file in another.
    "hash_folders": "SELECT id, session_id, concat('/by hash/', coalesce(pixel_hash, 'none'), '/', cast(id AS STRING), '.jpg') AS path, pixel_hash, status FROM {files}",
    # Every event is a click on a file, some of them of no known action, scope or file.
    "decision_log": f"""
SELECT event_id AS n, event_id * 31 % (SELECT max(doc_id) + 2 FROM {{documents}}) AS file_id,
       CASE event_type WHEN 'click' THEN 'keep' WHEN 'signup' THEN 'ignore' WHEN 'view' THEN 'share' ELSE 'delete' END AS action,
       CASE event_id % 43 WHEN 0 THEN 'all' WHEN 1 THEN 'folder' ELSE 'file' END AS scope, {_DAY.format("event_id")} AS decided_at
FROM {{events}}""",
    # Paths whose flattened names clash: two separators, and numbers that are also part of names.
    "tangled_files": """
SELECT id, cast(1 AS BIGINT) AS session_id, size, pixel_hash, status,
       concat('/photos', CASE id % 2 WHEN 0 THEN '/' ELSE '_' END, 'IMG_', cast(cast(floor(id / 8) AS BIGINT) AS STRING), CASE cast(floor(id / 2) AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN '_1' WHEN 2 THEN '_1_1' ELSE '_2' END, '.jpg') AS path
FROM {files}""",
    "tangled_actions": """
SELECT doc_id AS id, cast(1 AS BIGINT) AS session_id, doc_id AS file_id, 'delete' AS action, 'file' AS scope, '2024-05-01' AS decided_at, cast(NULL AS STRING) AS executed_at
FROM {labels} WHERE doc_id IN (SELECT id FROM {files})""",
    "tangled_bin": """
SELECT DISTINCT cast(1 AS BIGINT) AS session_id, id + 1000000000 AS file_id, path AS original_path, concat('/trash/1/', replace(path, '/', '_')) AS trash_path,
       '2024-05-01' AS deleted_at, '2024-05-31' AS expires_at, cast(NULL AS STRING) AS recovered_at
FROM {tangled_files} WHERE id NOT IN (SELECT file_id FROM {tangled_actions}) AND path LIKE '/photos/%'""",
    "sessions": """
SELECT cast(session_id AS BIGINT) AS id, concat('scan ', cast(session_id AS STRING)) AS name, 'complete' AS status, '2024-05-01' AS created_at
FROM (SELECT DISTINCT session_id FROM {files}) s""",
    "session_folders": "SELECT DISTINCT session_id, concat('/', split_part(path, '/', 2), '/', split_part(path, '/', 3)) AS folder_path FROM {files}",
    "file_actions": f"""
SELECT l.doc_id AS id, f.session_id, l.doc_id AS file_id, CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'keep' ELSE 'ignore' END AS action,
       CASE WHEN l.doc_id % 5 = 0 THEN 'folder' ELSE 'file' END AS scope, {_DAY.format("l.doc_id")} AS decided_at,
       CASE WHEN l.doc_id % 19 = 0 THEN '2024-06-01' END AS executed_at
FROM {{labels}} l JOIN {{files}} f ON f.id = l.doc_id""",
    "soft_deletes": f"""
SELECT event_id AS id, user_id % 2 + 1 AS session_id, event_id AS file_id, concat('/p/', cast(event_id AS STRING)) AS original_path,
       {_DAY.format("event_id")} AS deleted_at, {_DAY.format("(event_id + 1)")} AS expires_at, CASE WHEN event_id % 5 = 0 THEN '2024-07-01' END AS recovered_at
FROM {{events}} WHERE event_type IN ('error', 'purchase')""",
    "requests": f"""
SELECT event_id AS id, user_id % 2 + 1 AS session_id, md5(cast(event_id % 97 AS STRING)) AS pixel_hash, concat('peer', cast(user_id % 7 AS STRING)) AS target_peer,
       CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'denied' ELSE 'fulfilled' END AS status,
       {_DAY.format("event_id")} AS requested_at, cast(NULL AS STRING) AS responded_at, cast(NULL AS STRING) AS fulfilled_at
FROM {{events}} WHERE event_type = 'signup'""",
    "remote_peers": "SELECT cast(substr(source, 4) AS BIGINT) AS id, source AS username FROM (SELECT DISTINCT source FROM {documents}) p",
    "remote_files": """
SELECT doc_id AS id, cast(substr(source, 4) AS BIGINT) AS peer_id, cast(doc_id AS STRING) AS remote_id, concat('doc_', cast(doc_id AS STRING), '.jpg') AS filename,
       concat('/', source, '/doc_', cast(doc_id AS STRING), '.jpg') AS path, n_chars AS size, md5(text) AS pixel_hash
FROM {documents} WHERE doc_id % 3 = 0""",
    "local_files": "SELECT * FROM {files} WHERE id % 3 <> 0",
    "app_config": "SELECT cast(1 AS BIGINT) AS id, 'en' AS language, 'system' AS theme, cast(count(*) AS INT) AS max_scan_workers, true AS perf_logging FROM {region}",
    "sync_config": """
SELECT cast(1 AS BIGINT) AS id, 'ann' AS local_username, cast(NULL AS STRING) AS gdrive_folder_id, false AS sync_enabled, 'filename' AS export_privacy, cast(count(*) AS INT) AS scan_delay_ms FROM {region}""",
    "telemetry": """
SELECT user_id AS run_id, event_id AS row_id, ts AS noted_at, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS stage,
       event_id * 3 AS files, event_id % 9 AS active, cast(8 AS BIGINT) AS workers, event_id % 40 AS waiting, event_id % 7 AS queued, event_id * 2 AS lock_us, event_id * 5 AS events
FROM {events}""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied or derived table; nothing is registered in the session."""
    if name in SUPPLIED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in sorted(set(re.findall(r"\{(\w+)\}", text)))})


#: Folders of tables that belong to a catalog, by application, catalog and name.
_MADE: dict[tuple[str, str, str], str] = {}


def made_once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], str]) -> str:
    """The folder that make() gives, made once for a catalog in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def materialised(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once for a catalog in an application and kept in the shared folder."""
    return spark.read.parquet(made_once(spark, sf_dir, name, lambda: write(make(), name)))


def for_duckdb(query: str) -> str:
    """query, whose {names} are tables, with the derived ones it needs as WITH clauses before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in SQL and n not in needed:
                visit(SQL[n])
                needed.append(n)

    visit(query)
    plain = lambda t: re.sub(r"\{([a-z]\w*)\}", r"\1", t).strip()
    clauses = [f"{n} AS ({plain(SQL[n])})" for n in needed]
    body = plain(query)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return start + ", ".join([*clauses, body[len(start) :]])
    return ("WITH " + ", ".join(clauses) + "\n" if clauses else "") + body
