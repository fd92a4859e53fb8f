"""Queries on the catalog: duplicates, keepers, the plan, peers. Name, job and SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.operators import catalog, duplicates, peers, plan, ranking, similarity
from gleaner.plans.domain import load
from gleaner.sources import files as sources
from gleaner.plans.similarity_queries import _RECURSIVE, _files

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return register


# ---- projections and filters


@query("SELECT id, path, status FROM {files} WHERE session_id = 1")
def session_files(spark, d):
    return load(spark, d, "files").filter("session_id = 1").select("id", "path", "status")


@query("SELECT s.id, s.name, s.status, p.username FROM {sessions} s, {remote_peers} p WHERE s.id = 2 AND p.username = (SELECT max(username) FROM {remote_peers})")
def session_and_peer_lookup(spark, d):
    """A session by its id and a peer by its name."""
    known = load(spark, d, "remote_peers")
    name = known.agg(F.max("username")).first()[0]
    session = load(spark, d, "sessions").filter("id = 2").select("id", "name", "status")
    return session.join(known.filter(F.col("username") == name).select("username"), F.lit(True))  # one row each


@query("SELECT session_id, folder_path FROM {session_folders} WHERE session_id = 2")
def session_folder_list(spark, d):
    return load(spark, d, "session_folders").filter("session_id = 2")


@query("SELECT * FROM {files} WHERE session_id = 1 AND status = 'active' AND pixel_hash = (SELECT min(pixel_hash) FROM {files} WHERE session_id = 1 AND status = 'active')")
def files_of_hash(spark, d):
    files = load(spark, d, "files").filter("session_id = 1 AND status = 'active'")
    least = files.agg(F.min("pixel_hash").alias("h"))
    return files.join(F.broadcast(least), files.pixel_hash == least.h).drop("h")  # one row is broadcast


@query("SELECT id, path, size, modified_at, pixel_hash FROM {files} WHERE session_id = 1 AND status = 'active' AND modified_at >= '2024-03-01' AND modified_at <= '2024-09-30' AND (lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.heic') AND pixel_hash IS NOT NULL")
def filter_builder(spark, d):
    return duplicates._filtered(load(spark, d, "files"), 1, "2024-03-01", "2024-09-30", [".jpg", ".heic"]).select("id", "path", "size", "modified_at", "pixel_hash")


@query("SELECT file_id, action FROM {file_actions} WHERE session_id = 1")
def session_actions(spark, d):
    return load(spark, d, "file_actions").filter("session_id = 1").select("file_id", "action")


@query("SELECT id, file_id, deleted_at FROM {soft_deletes} WHERE session_id = 1 AND recovered_at IS NULL")
def bin_items(spark, d):
    return plan.in_bin(load(spark, d, "soft_deletes"), 1).select("id", "file_id", "deleted_at")


@query("SELECT id, session_id, expires_at FROM {soft_deletes} WHERE expires_at < '2024-05-01' AND recovered_at IS NULL")
def bin_expired(spark, d):
    return plan.expired(load(spark, d, "soft_deletes"), "2024-05-01").select("id", "session_id", "expires_at")


@query("SELECT b.id, b.file_id, f.thumbnail_path FROM {soft_deletes} b LEFT JOIN {files} f ON f.id = b.file_id WHERE b.session_id = 1 AND b.recovered_at IS NULL")
def bin_with_thumbnails(spark, d):
    thumbs = load(spark, d, "files").select(F.col("id").alias("file_id"), "thumbnail_path")
    return plan.in_bin(load(spark, d, "soft_deletes"), 1).join(thumbs, "file_id", "left").select("id", "file_id", "thumbnail_path")


@query("SELECT id, pixel_hash, target_peer, status FROM {requests} WHERE session_id = 1")
def requests_of_session(spark, d):
    return peers.requests_of(load(spark, d, "requests"), 1).select("id", "pixel_hash", "target_peer", "status")


@query("SELECT id, pixel_hash, target_peer FROM {requests} WHERE session_id = 1 AND status = 'pending'")
def requests_to_review(spark, d):
    return peers.to_review(load(spark, d, "requests"), 1).select("id", "pixel_hash", "target_peer")


@query("SELECT id, session_id, pixel_hash FROM {requests} WHERE target_peer = 'peer3'")
def requests_incoming(spark, d):
    return peers.incoming(load(spark, d, "requests"), "peer3").select("id", "session_id", "pixel_hash")


@query("SELECT coalesce(bool_or(session_id = 1 AND pixel_hash = md5('3') AND status IN ('pending', 'approved')), false) AS requested FROM {requests}")
def request_exists(spark, d):
    return peers.is_requested(load(spark, d, "requests"), 1, "eccbc87e4b5ce2fe28308fd9f2a7baf3")


@query("""
SELECT id, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS name, length(path) - length(replace(path, '/', '')) AS depth, replace(path, '/', '_') AS flat,
       CASE WHEN size < 1000 THEN concat(size::VARCHAR, ' B') WHEN size < 1000000 THEN printf('%.1f KB', size / 1000.0::DOUBLE) ELSE printf('%.1f MB', size / 1000000.0::DOUBLE) END AS size_text,
       CASE WHEN size IS NULL THEN NULL WHEN size = 0 THEN '0 B' WHEN size < 1024 THEN concat(size::VARCHAR, '.0 B')
            ELSE concat(((size * 20 + unit) // (2 * unit) // 10)::VARCHAR, '.', ((size * 20 + unit) // (2 * unit) % 10)::VARCHAR, CASE unit WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' WHEN 1073741824 THEN ' GB' ELSE ' TB' END) END AS bytes_text,
       regexp_matches(coalesce(pixel_hash, ''), '^([0-9a-f]{32}|[0-9a-f]{64})$') AS well_formed, CASE WHEN length(pixel_hash) = 32 THEN 'xxh128' ELSE 'sha256' END AS algorithm,
       CASE WHEN id / 60 < 1 THEN concat(id::VARCHAR, 's') ELSE concat((id // 60)::VARCHAR, 'm ', (id % 60)::VARCHAR, 's') END AS duration
FROM (SELECT *, CASE WHEN size < 1048576 THEN 1024 WHEN size < 1073741824 THEN 1048576 WHEN size < 1099511627776 THEN 1073741824 ELSE 1099511627776 END AS unit FROM {files})""")
def path_functions(spark, d):
    p, n = F.col("path"), F.col("size")
    return load(spark, d, "files").select(
        "id", paths.parent(p).alias("folder"), paths.basename(p).alias("name"), paths.depth(p).cast("long").alias("depth"), paths.trash_name(p).alias("flat"),
        paths.size_text(n).alias("size_text"), paths.bytes_text(n).alias("bytes_text"), F.coalesce("pixel_hash", F.lit("")).rlike(paths.HASH_FORM).alias("well_formed"),
        paths.algorithm(F.col("pixel_hash")).alias("algorithm"), paths.duration_text(F.col("id")).alias("duration"),
    )


@query("""SELECT id, regexp_matches(regexp_extract(path, '[^/]*$'), '^[A-Za-z0-9_-]{1,64}$') AS name_is_user, regexp_matches(regexp_extract(path, '/([^/]*)/[^/]*$', 1), '^[A-Za-z0-9_-]{1,64}$') AS source_is_user,
regexp_matches(coalesce(pixel_hash, ''), '^[A-Za-z0-9_-]{25,50}$') AS hash_is_folder, regexp_matches(path, '^[A-Za-z0-9_-]{25,50}$') AS path_is_folder,
CASE WHEN thumbnail_path IS NOT NULL THEN concat('data:image/jpeg;base64,', to_base64(encode(thumbnail_path))) ELSE '' END AS thumbnail, CASE WHEN id % 2 = 0 AND thumbnail_path IS NOT NULL THEN concat('data:image/jpeg;base64,', to_base64(encode(thumbnail_path))) ELSE '' END AS guarded FROM {files}""")
def validation_forms(spark, d):
    """Whether texts have the forms of user names and folder ids; thumbnails by their path, and those of odd ids by a path that leaves the folder."""
    p, t = F.col("path"), F.col("thumbnail_path")
    away = F.when(F.col("id") % 2 == 0, t).otherwise(F.concat(t, F.lit("/../../etc/passwd")))
    return load(spark, d, "files").select(
        "id", paths.basename(p).rlike(paths.USER_FORM).alias("name_is_user"), paths.basename(paths.parent(p)).rlike(paths.USER_FORM).alias("source_is_user"),
        F.coalesce("pixel_hash", F.lit("")).rlike(paths.FOLDER_ID_FORM).alias("hash_is_folder"), p.rlike(paths.FOLDER_ID_FORM).alias("path_is_folder"),
        paths.safe_data_uri(t, F.encode(t, "utf-8"), "/thumbs").alias("thumbnail"), paths.safe_data_uri(away, F.encode(t, "utf-8"), "/thumbs/").alias("guarded"),
    )


# ---- ingest


@query("SELECT session_id, path, id FROM {files} UNION ALL SELECT session_id + 2, path, (SELECT max(id) FROM {files}) + row_number() OVER (ORDER BY session_id, path) FROM {files}")
def ingest_files(spark, d):
    """All files are found again in their own session, where they are known, and in another, twice."""
    files = load(spark, d, "files").select("id", "session_id", "path", "size")
    again = files.select("session_id", "path", "size")
    other = again.withColumn("session_id", F.col("session_id") + 2)
    return sources.ingest(files, again.unionByName(other).unionByName(other)).select("session_id", "path", "id")


# ---- duplicates


@query("SELECT id, size FROM {files} WHERE session_id = 1 AND pixel_hash IS NULL AND size IN (SELECT size FROM {files} WHERE session_id = 1 AND size IS NOT NULL GROUP BY size HAVING count(*) > 1)")
def size_collisions(spark, d):
    return duplicates.size_collisions(load(spark, d, "files"), 1).select("id", "size")


@query("SELECT coalesce(sum(n), 0)::BIGINT AS candidates FROM (SELECT count(*) AS n FROM {files} WHERE session_id = 1 AND size IS NOT NULL GROUP BY size HAVING count(*) > 1)")
def size_collision_total(spark, d):
    return duplicates.size_collision_total(load(spark, d, "files"), 1)


@query("SELECT session_id, pixel_hash, hash_algorithm, count(*) AS file_count FROM {files} WHERE status = 'active' AND pixel_hash IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return duplicates.duplicate_groups(load(spark, d, "files"))


_GROUPS = """
SELECT pixel_hash, count(*) AS file_count, sum(size)::BIGINT AS total_size, min(modified_at) AS first_modified, max(modified_at) AS last_modified, min(length(path)) AS path_length
FROM {files} WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL"""


@query(_GROUPS + " GROUP BY pixel_hash HAVING count(*) >= 2 ORDER BY total_size DESC NULLS LAST, pixel_hash LIMIT 20 OFFSET 3")
def filtered_groups_by_waste(spark, d):
    return duplicates.filtered_groups(load(spark, d, "files"), 1, limit=20, offset=3)


@query(_GROUPS + " AND modified_at >= '2024-02-01' AND modified_at <= '2024-11-30' AND (lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.heic' OR lower(path) LIKE '%.jpeg') GROUP BY pixel_hash HAVING count(*) >= 2")
def filtered_groups_by_copies(spark, d):
    return duplicates.filtered_groups(load(spark, d, "files"), 1, "2024-02-01", "2024-11-30", [".JPG", ".heic", ".jpeg"], 1, "copies", False)


@query("SELECT count(*) AS total_count FROM (SELECT pixel_hash FROM {files} WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)")
def filtered_group_count(spark, d):
    return duplicates.filtered_group_count(load(spark, d, "files"), 1, 3)


_DUPLICATES = """
WITH dup AS (
  SELECT *, count(*) OVER (PARTITION BY pixel_hash, hash_algorithm) AS copies FROM {files} WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL
  QUALIFY copies > 1
)"""


@query(_DUPLICATES + " SELECT id, pixel_hash, size, modified_at, copies FROM dup")
def duplicate_files(spark, d):
    return duplicates.duplicate_files(load(spark, d, "files"), 1).select("id", "pixel_hash", "size", "modified_at", "copies")


@query(_DUPLICATES + " SELECT pixel_hash, count(*) OVER (PARTITION BY pixel_hash) AS file_count, row_number() OVER (PARTITION BY pixel_hash ORDER BY id) AS position, id FROM dup")
def duplicate_ids(spark, d):
    return duplicates.duplicate_ids(load(spark, d, "files"), 1)


@query("SELECT count(*) AS total, count(pixel_hash) AS hashed FROM {files} WHERE session_id = 1 AND status = 'active' AND path ILIKE '/EN/src1%'")
def folder_progress(spark, d):
    return duplicates.folder_progress(load(spark, d, "files"), 1, "/EN/src1")


@query("""
WITH marked AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) OVER (PARTITION BY pixel_hash) > 1 AS again FROM {hash_folders}
  WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL)
SELECT folder, count(*) AS files FROM marked GROUP BY 1 HAVING bool_and(again)""")
def fully_duplicated_folders(spark, d):
    return duplicates.fully_duplicated_folders(load(spark, d, "hash_folders"), 1)


@query(_DUPLICATES + " SELECT pixel_hash, hash_algorithm, count(*) AS file_count, coalesce(sum(size) FILTER (size > 0) - max(size) FILTER (size > 0), 0)::BIGINT AS recoverable_bytes FROM dup GROUP BY 1, 2")
def recoverable_bytes(spark, d):
    return duplicates.recoverable(load(spark, d, "files"), 1)


@query(_RECURSIVE + ", " + _DUPLICATES.strip().removeprefix("WITH ") + """, g AS (SELECT pixel_hash, count(*) AS n, coalesce(sum(size) FILTER (size > 0) - max(size) FILTER (size > 0), 0) AS bytes FROM dup GROUP BY 1)
SELECT (SELECT count(*) FROM {files} WHERE session_id = 1) AS total_files, (SELECT count(*) FROM g) AS duplicate_groups, (SELECT coalesce(sum(n), 0) FROM g)::BIGINT AS duplicate_files,
       (SELECT coalesce(sum(bytes), 0) FROM g)::BIGINT AS recoverable_bytes, (SELECT count(DISTINCT group_id) FROM members)::BIGINT AS similarity_groups""")
def scan_summary(spark, d):
    near = similarity.group_table(similarity.similarity_groups(_files(spark, d), 1), 1)
    return duplicates.scan_summary(load(spark, d, "files"), 1, near)


@query("""SELECT s.id, s.name, s.status, (SELECT count(*) FROM {session_folders} f WHERE f.session_id = s.id) AS folder_count, (SELECT count(*) FROM {files} f WHERE f.session_id = s.id) AS file_count
FROM {sessions} s WHERE s.id = (SELECT max(id) FROM {sessions})""")
def session_overview(spark, d):
    return duplicates.session_overview(load(spark, d, "sessions"), load(spark, d, "session_folders"), load(spark, d, "files"))


@query("SELECT pixel_hash, count(*) AS total FROM {files} WHERE session_id = 1 AND pixel_hash IS NOT NULL GROUP BY 1")
def hash_totals(spark, d):
    return duplicates.hash_totals(load(spark, d, "files"), 1)


@query("""SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS pending FROM {files} WHERE session_id = 1 AND pixel_hash IS NULL
AND size IN (SELECT size FROM {files} WHERE session_id = 1 AND size IS NOT NULL GROUP BY size HAVING count(*) > 1) GROUP BY 1""")
def pending_folders(spark, d):
    return duplicates.pending_folders(load(spark, d, "files"), 1)


@query(_DUPLICATES + """, page AS (SELECT pixel_hash, hash_algorithm, count(*) AS n FROM dup GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10 OFFSET 5)
SELECT d.pixel_hash, p.n AS file_count, row_number() OVER (PARTITION BY d.pixel_hash ORDER BY coalesce(size, -1) DESC, id) AS position, id, path FROM dup d JOIN page p USING (pixel_hash)""")
def group_page(spark, d):
    page = duplicates.group_page(load(spark, d, "files"), 1, 5, 10)
    return page.select("pixel_hash", "file_count", F.posexplode("files").alias("i", "f")).select("pixel_hash", "file_count", (F.col("i") + 1).cast("long").alias("position"), "f.id", "f.path")


@query("SELECT DISTINCT thumbnail_path FROM {files} WHERE status <> 'active' AND thumbnail_path IS NOT NULL AND pixel_hash NOT IN (SELECT pixel_hash FROM {files} WHERE status = 'active')")
def unreferenced_thumbnails_none(spark, d):
    return duplicates.unreferenced_thumbnails(load(spark, d, "files"))


@query("SELECT DISTINCT thumbnail_path FROM {files} WHERE pixel_hash IS NOT NULL AND status <> 'active' AND thumbnail_path IS NOT NULL AND pixel_hash NOT IN (SELECT pixel_hash FROM {files} WHERE status = 'active' AND pixel_hash IS NOT NULL)")
def unreferenced_thumbnails(spark, d):
    return duplicates.unreferenced_thumbnails(load(spark, d, "files").filter("pixel_hash IS NOT NULL"))


# ---- keepers

_DEPTH = "(length(path) - length(replace(path, '/', '')))"
_RES = "(coalesce(width, 0)::BIGINT * coalesce(height, 0)::BIGINT)"
_SIZE = "coalesce(size, 0)"
# Dates here have one length, so "missing first, then latest first" is the order of their negated code points.
_NEWEST = "(coalesce(modified_at, '') <> ''), modified_at DESC"
_TIES = "size DESC NULLS LAST, modified_at DESC NULLS LAST, id"
_CHAINS = {
    "KEEP_LARGEST_FILE": f"{_SIZE} DESC, {_NEWEST}, {_DEPTH}",
    "KEEP_HIGHEST_RESOLUTION": f"{_RES} DESC, {_SIZE} DESC, {_NEWEST}",
    "KEEP_NEWEST": f"{_NEWEST}, {_SIZE} DESC, {_DEPTH}",
    "KEEP_OLDEST": f"coalesce(modified_at, ''), {_SIZE} DESC, {_DEPTH}",
    "KEEP_SHORTEST_PATH": f"{_DEPTH}, {_SIZE} DESC, {_NEWEST}",
    "KEEP_DEEPEST_PATH": f"{_DEPTH} DESC, {_SIZE} DESC, {_NEWEST}",
}


def _preset(chain, order: str) -> tuple:
    def run(spark, d):
        return ranking.apply_preset(duplicates.duplicate_files(load(spark, d, "files"), 1), chain)

    return run, _DUPLICATES + f" SELECT id, pixel_hash, CASE WHEN row_number() OVER (PARTITION BY pixel_hash ORDER BY {order}, {_TIES}) = 1 THEN 'keep' ELSE 'delete' END AS action FROM dup"


for _name, _order in _CHAINS.items():
    REGISTERED[f"preset_{_name.lower()}"] = _preset(ranking.PRESETS[_name], _order)
REGISTERED["custom_chain_name_then_size"] = _preset((ranking.Criterion("filename_length", True), ranking.Criterion("size", True)), f"length(regexp_extract(path, '[^/]*$')), {_SIZE}")
REGISTERED["custom_chain_resolution_then_old"] = _preset((ranking.Criterion("resolution", True), ranking.Criterion("modified_at", True)), f"{_RES}, coalesce(modified_at, '')")


@query(_DUPLICATES + f" SELECT action, count(*) AS files FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY pixel_hash ORDER BY {_CHAINS['KEEP_LARGEST_FILE']}, {_TIES}) = 1 THEN 'keep' ELSE 'delete' END AS action FROM dup) GROUP BY 1")
def selection_counts(spark, d):
    return ranking.apply_preset(duplicates.duplicate_files(load(spark, d, "files"), 1), ranking.PRESETS["KEEP_LARGEST_FILE"]).groupBy("action").agg(F.count("*").alias("files"))


@query(_DUPLICATES + " SELECT pixel_hash, id AS master_id FROM dup QUALIFY row_number() OVER (PARTITION BY pixel_hash ORDER BY coalesce(size, 0) DESC, coalesce(modified_at, '') DESC, path, id) = 1")
def master_copies(spark, d):
    return ranking.master_copies(duplicates.duplicate_files(load(spark, d, "files"), 1))


@query("""
WITH j AS (SELECT f.id, f.session_id, f.pixel_hash, a.action FROM {files} f LEFT JOIN {file_actions} a ON a.file_id = f.id AND a.session_id = f.session_id WHERE f.status = 'active' AND f.pixel_hash IS NOT NULL),
w AS (SELECT *, count(*) FILTER (action IS NULL) OVER (PARTITION BY session_id, pixel_hash) AS undecided FROM j)
SELECT session_id, id, pixel_hash, 'keep' AS action FROM w WHERE undecided = 1 AND action IS NULL""")
def last_undecided(spark, d):
    return ranking.last_undecided(load(spark, d, "files"), load(spark, d, "file_actions"))


@query(_DUPLICATES + " SELECT id AS file_id, CASE WHEN id = min(id) OVER (PARTITION BY pixel_hash) THEN 'keep' ELSE 'delete' END AS action FROM dup")
def keep_and_delete_others(spark, d):
    """The first file of every duplicate group is kept."""
    same = duplicates.duplicate_files(load(spark, d, "files"), 1)
    return ranking.keep_one_of_each(same.groupBy("pixel_hash").agg(F.min("id").alias("id")), same, "pixel_hash")


# ---- the plan


@query("""
SELECT coalesce(count(*) FILTER (a.action = 'delete'), 0) AS delete_count, coalesce(sum(f.size) FILTER (a.action = 'delete'), 0)::BIGINT AS delete_bytes, count(*) FILTER (a.action = 'keep') AS keep_count,
       count(*) FILTER (a.action = 'ignore') AS ignore_count, count(*) FILTER (a.action = 'delete' AND a.scope = 'folder') AS folder_count
FROM {file_actions} a JOIN {files} f ON f.id = a.file_id WHERE a.session_id = 1 AND a.executed_at IS NULL""")
def plan_summary(spark, d):
    return plan.summary(load(spark, d, "file_actions"), load(spark, d, "files"), 1)


@query("SELECT f.id AS file_id, a.scope, f.path, f.size, coalesce(f.pixel_hash, '') AS pixel_hash FROM {file_actions} a JOIN {files} f ON f.id = a.file_id WHERE a.session_id = 1 AND a.executed_at IS NULL AND a.action = 'delete'")
def plan_deletions(spark, d):
    return plan.deletions(load(spark, d, "file_actions"), load(spark, d, "files"), 1)


@query("""WITH gone AS (SELECT f.id AS file_id, f.path, f.size, coalesce(f.pixel_hash, '') AS pixel_hash FROM {file_actions} a JOIN {files} f ON f.id = a.file_id WHERE a.session_id = 1 AND a.executed_at IS NULL AND a.action = 'delete'),
n AS (SELECT count(*) FILTER (a.action = 'keep') AS keep_count, count(*) FILTER (a.action = 'delete') AS delete_count, count(*) FILTER (a.action = 'ignore') AS ignore_count, coalesce(sum(f.size) FILTER (a.action = 'delete'), 0)::BIGINT AS total_size_bytes
  FROM {file_actions} a JOIN {files} f ON f.id = a.file_id WHERE a.session_id = 1 AND a.executed_at IS NULL)
SELECT g.*, 'delete' AS action, n.* FROM n LEFT JOIN gone g ON true""")
def plan_review(spark, d):
    return plan.review(load(spark, d, "file_actions"), load(spark, d, "files"), 1)


@query(_DUPLICATES + " SELECT file_id, action FROM {file_actions} WHERE NOT (session_id = 1 AND file_id IN (SELECT id FROM dup))")
def clear_duplicate_actions(spark, d):
    ids = duplicates.duplicate_files(load(spark, d, "files"), 1).select(F.col("id").alias("file_id"))
    return plan.clear_for(load(spark, d, "file_actions"), ids, 1).select("file_id", "action")


@query("""
WITH hit AS (SELECT id, count(*) OVER (PARTITION BY pixel_hash) AS copies, path FROM {files} WHERE session_id = 1 AND pixel_hash IS NOT NULL),
ch AS (SELECT id FROM hit WHERE copies > 1 AND replace(path, '\\', '/') ILIKE '/en/%')
SELECT coalesce(a.file_id, c.id) AS file_id, CASE WHEN c.id IS NOT NULL THEN 'delete' ELSE a.action END AS action, CASE WHEN c.id IS NOT NULL THEN 'folder' ELSE a.scope END AS scope, a.executed_at
FROM {file_actions} a FULL JOIN ch c ON c.id = a.file_id AND a.session_id = 1""")
def folder_action(spark, d):
    return plan.folder_action(load(spark, d, "files"), load(spark, d, "file_actions"), 1, "\\EN\\", "delete").select("file_id", "action", "scope", "executed_at")


@query("""
WITH ch AS (SELECT session_id, id AS file_id, CASE id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'delete' ELSE 'ignore' END AS action FROM {files})
SELECT coalesce(a.session_id, c.session_id) AS session_id, coalesce(a.file_id, c.file_id) AS file_id, coalesce(c.action, a.action) AS action, a.executed_at
FROM {file_actions} a FULL JOIN ch c ON a.session_id = c.session_id AND a.file_id = c.file_id""")
def upsert_actions(spark, d):
    files = load(spark, d, "files")
    late = files.select("session_id", F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, "keep").when(F.col("id") % 3 == 1, "delete").otherwise("ignore").alias("action"), F.lit(2).alias("n"))
    early = late.withColumns({"action": F.lit("ignore"), "n": F.lit(1)})
    return plan.upsert_actions(load(spark, d, "file_actions"), early.unionByName(late), "n").select("session_id", "file_id", "action", "executed_at")


@query("""
WITH ch AS (SELECT session_id, id AS file_id, CASE id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'delete' ELSE 'ignore' END AS action FROM {files} WHERE status = 'active')
SELECT coalesce(a.session_id, c.session_id) AS session_id, coalesce(a.file_id, c.file_id) AS file_id, coalesce(c.action, a.action) AS action
FROM {file_actions} a FULL JOIN ch c ON a.session_id = c.session_id AND a.file_id = c.file_id WHERE a.action IS DISTINCT FROM c.action""")
def toggle_actions(spark, d):
    """A click on every active file: its decision is made, replaced or cleared; decisions on the other files stay."""
    asked = F.when(F.col("id") % 3 == 0, "keep").when(F.col("id") % 3 == 1, "delete").otherwise("ignore").alias("action")
    clicks = load(spark, d, "files").filter("status = 'active'").select("session_id", F.col("id").alias("file_id"), asked)
    return plan.toggle(load(spark, d, "file_actions"), clicks)


# Names are found one deletion after the other here, by a recursion in the order of their paths.
_EXECUTED = """WITH RECURSIVE todo AS (SELECT a.file_id, f.path, replace(f.path, '/', '_') AS flat, regexp_replace(replace(f.path, '/', '_'), '\\.jpg$', '') AS stem, row_number() OVER (ORDER BY f.path, a.file_id) AS i
  FROM {tangled_actions} a JOIN {tangled_files} f ON f.id = a.file_id),
walk(i, file_id, name, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, '', (SELECT list(replace(trash_path, '/trash/1/', '')) FROM {tangled_bin})
  UNION ALL SELECT i, file_id, name, list_append(taken, name) FROM (
    SELECT t.i, t.file_id, w.taken, list_filter(list_transform(range(40), lambda k: CASE k WHEN 0 THEN t.flat ELSE concat(t.stem, '_', k::VARCHAR, '.jpg') END), lambda x: NOT list_contains(w.taken, x))[1] AS name FROM walk w JOIN todo t ON t.i = w.i + 1) s)"""


def _executed(spark, d):
    return plan.execute(load(spark, d, "tangled_actions"), load(spark, d, "tangled_files"), load(spark, d, "tangled_bin"), 1, F.to_timestamp(F.lit("2024-06-01T00:00:00Z")), "/trash")


@query(_EXECUTED + """ SELECT file_id, original_path, trash_path, deleted_at, expires_at FROM {tangled_bin} UNION ALL
SELECT t.file_id, t.path, concat('/trash/1/', w.name), '2024-06-01T00:00:00Z', '2024-07-01T00:00:00Z' FROM todo t JOIN walk w USING (file_id)""")
def execute_plan(spark, d):
    return _executed(spark, d)[2].select("file_id", "original_path", "trash_path", "deleted_at", "expires_at")


@query("SELECT count(*) AS items, count(*) AS names FROM (SELECT file_id FROM {tangled_bin} UNION ALL SELECT file_id FROM {tangled_actions})")
def execute_plan_unique_names(spark, d):
    return _executed(spark, d)[2].agg(F.count("*").alias("items"), F.count_distinct("trash_path").alias("names"))


@query("SELECT session_id, file_id, action, '2024-06-01T00:00:00Z' AS executed_at FROM {tangled_actions}")
def execute_plan_actions(spark, d):
    return _executed(spark, d)[0].select("session_id", "file_id", "action", "executed_at")


@query("SELECT id, CASE WHEN id IN (SELECT file_id FROM {tangled_actions}) THEN 'deleted' ELSE status END AS status FROM {tangled_files}")
def execute_plan_files(spark, d):
    return _executed(spark, d)[1].select("id", "status")


@query("SELECT f.id, f.path, a.action FROM {files} f LEFT JOIN {file_actions} a ON a.file_id = f.id WHERE f.session_id = 1 AND f.status = 'active' AND f.pixel_hash IN (SELECT pixel_hash FROM {files} WHERE session_id = 1 AND status = 'active' GROUP BY 1 HAVING count(*) > 1)")
def group_detail(spark, d):
    acts = load(spark, d, "file_actions").select(F.col("file_id").alias("id"), "action")
    return duplicates.duplicate_files(load(spark, d, "files"), 1).join(acts, "id", "left").select("id", "path", "action")


@query("SELECT id, CASE WHEN path ILIKE '/de/src\\_1/%' ESCAPE '\\' OR path ILIKE '/de/src1/%' THEN 'deleted' ELSE status END AS status FROM {files} WHERE session_id = 2")
def deactivate_folder(spark, d):
    files = load(spark, d, "files")
    return catalog.deactivate_folder(catalog.deactivate_folder(files, 2, "/de/src_1"), 2, "/de/src1").filter("session_id = 2").select("id", "status")


@query("SELECT (expires_at::DATE - DATE '2024-06-15')::BIGINT AS days_left, count(*) AS items FROM {soft_deletes} WHERE recovered_at IS NULL GROUP BY 1")
def bin_countdown(spark, d):
    left = plan.days_left(F.to_timestamp("expires_at"), F.to_timestamp(F.lit("2024-06-15"))).cast("long")
    return load(spark, d, "soft_deletes").filter("recovered_at IS NULL").groupBy(left.alias("days_left")).agg(F.count("*").alias("items"))


# ---- peers


@query("""SELECT f.id AS file_id, f.path AS local_path, f.pixel_hash, p.username, r.filename AS remote_filename, r.size AS remote_size
FROM {local_files} f JOIN {remote_files} r ON r.pixel_hash = f.pixel_hash JOIN {remote_peers} p ON p.id = r.peer_id WHERE f.session_id = 1 AND f.status = 'active'""")
def peer_matches(spark, d):
    return peers.matches(load(spark, d, "local_files"), load(spark, d, "remote_files"), load(spark, d, "remote_peers"), 1)


_TREASURES = "FROM {remote_files} r JOIN {remote_peers} p ON p.id = r.peer_id WHERE r.pixel_hash NOT IN (SELECT pixel_hash FROM {local_files} WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL)"


@query("SELECT p.username, r.filename, r.pixel_hash, r.size " + _TREASURES)
def peer_treasures(spark, d):
    return peers.treasures(load(spark, d, "local_files"), load(spark, d, "remote_files"), load(spark, d, "remote_peers"), 1)


@query("SELECT count(DISTINCT r.pixel_hash) AS treasures " + _TREASURES)
def peer_treasure_count(spark, d):
    return peers.treasure_count(load(spark, d, "local_files"), load(spark, d, "remote_files"), 1)


@query("SELECT concat('ann:', id::VARCHAR) AS remote_id, pixel_hash, size, modified_at, regexp_extract(path, '[^/]*$') AS filename, path FROM {files} WHERE session_id = 1 AND status = 'active' AND pixel_hash IS NOT NULL")
def export_rows(spark, d):
    return peers.export_rows(load(spark, d, "files"), 1, "ann", "full_path")


@query("SELECT remote_id, pixel_hash, substr(filename, 1, 1024) AS filename FROM {remote_files} WHERE regexp_matches(pixel_hash, '^[0-9a-f]{32}$')")
def import_entries(spark, d):
    bad = spark.createDataFrame([("x", "NOTAHASH", "f")], "remote_id string, pixel_hash string, filename string")
    return peers.valid_entries(load(spark, d, "remote_files").select("remote_id", "pixel_hash", "filename").unionByName(bad))


@query("SELECT pixel_hash, remote_id, filename, size FROM {remote_files}")
def nest_and_flatten(spark, d):
    rows = load(spark, d, "remote_files").select("pixel_hash", "remote_id", "filename", "size")
    return peers.lengthen(peers.shorten(peers.flat_entries(peers.nested_by_hash(rows))))


@query("""
WITH p AS (SELECT string_split(path, '/') AS parts FROM {deep_files}), e AS (SELECT array_to_string(parts[1:i], '/') AS root FROM p, range(1, len(parts)) t(i)),
c AS (SELECT root, count(*) AS times FROM e WHERE length(root) >= 10 GROUP BY 1 HAVING count(*) >= greatest(2, floor(0.005 * (SELECT count(*) FROM {deep_files}))))
SELECT concat('<R', (row_number() OVER (ORDER BY length(root) DESC, times DESC, root) - 1)::VARCHAR, '>') AS token, root, times FROM c ORDER BY length(root) DESC, times DESC, root LIMIT 8""")
def common_roots(spark, d):
    return peers.common_roots(load(spark, d, "deep_files"), 0.005)


@query("SELECT remote_id, peer_id FROM {remote_files} WHERE peer_id <> 3 UNION ALL SELECT concat('new', remote_id), 3 FROM {remote_files} WHERE peer_id = 5")
def replace_catalog(spark, d):
    remote = load(spark, d, "remote_files").select("remote_id", "peer_id")
    return peers.replace_catalog(remote, 3, remote.filter("peer_id = 5").select(F.concat(F.lit("new"), "remote_id").alias("remote_id")))


@query("SELECT id, CASE WHEN status = 'pending' AND session_id = 1 THEN 'approved' ELSE status END AS status, CASE WHEN status = 'pending' AND session_id = 1 THEN '2024-08-01' END AS responded_at FROM {requests}")
def respond_requests(spark, d):
    """All pending requests of a session are answered."""
    requests = load(spark, d, "requests")
    return peers.respond(requests, peers.to_review(requests, 1).select("id"), "approved", "2024-08-01").select("id", "status", "responded_at")


@query("""
WITH fresh AS (SELECT DISTINCT session_id, pixel_hash, 'peer1' AS target_peer FROM {files} WHERE pixel_hash IS NOT NULL)
SELECT session_id, pixel_hash, target_peer, status FROM {requests} UNION ALL
SELECT session_id, pixel_hash, target_peer, 'pending' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM {requests} r WHERE r.session_id = f.session_id AND r.pixel_hash = f.pixel_hash AND r.target_peer = f.target_peer)""")
def create_requests(spark, d):
    new = load(spark, d, "files").filter("pixel_hash IS NOT NULL").select("session_id", "pixel_hash", F.lit("peer1").alias("target_peer"), F.lit("pending").alias("status"))
    return peers.create_requests(load(spark, d, "requests"), new).select("session_id", "pixel_hash", "target_peer", "status")
