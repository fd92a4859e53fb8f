"""Queries on changes of the catalog: the tables after them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gleaner.operators import catalog, decisions, peers, plan, ranking
from gleaner.plans.catalog_queries import _CHAINS, _DUPLICATES, _TIES
from gleaner.plans.domain import load

REGISTERED: dict = {}


def query(sql: str | None):
    def register(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return register


@query("SELECT id, name, status, created_at FROM {sessions} UNION ALL SELECT max(id) + 1, 'again', 'in_progress', '2024-06-01' FROM {sessions}")
def create_session(spark, d):
    return catalog.create_session(load(spark, d, "sessions"), "again", "2024-06-01")


@query("SELECT id, CASE WHEN id = 1 THEN 'paused' ELSE status END AS status FROM {sessions}")
def session_status(spark, d):
    return catalog.set_session_status(load(spark, d, "sessions"), 1, "paused").select("id", "status")


@query("""SELECT 'sessions' AS name, count(*) AS rows FROM {sessions} WHERE id <> 2 UNION ALL SELECT 'session_folders', count(*) FROM {session_folders} WHERE session_id <> 2
UNION ALL SELECT 'files', count(*) FROM {files} WHERE session_id <> 2 UNION ALL SELECT 'file_actions', count(*) FROM {file_actions} WHERE session_id <> 2
UNION ALL SELECT 'requests', count(*) FROM {requests} WHERE session_id <> 2 UNION ALL SELECT 'soft_deletes', count(*) FROM {soft_deletes} WHERE session_id <> 2""")
def delete_session(spark, d):
    tables = {t: load(spark, d, t) for t in ("sessions", "session_folders", "files", "file_actions", "requests", "soft_deletes")}
    tables["soft_deletes"] = tables["soft_deletes"].filter("session_id <> 2")  # an empty bin, without which the session stays
    left = catalog.delete_session(tables, 2)
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t, df in left.items()])


@query("""SELECT id, CASE WHEN pixel_hash IS NULL THEN concat(md5(path), md5(id::VARCHAR)) ELSE pixel_hash END AS pixel_hash, CASE WHEN pixel_hash IS NULL THEN 'sha256' ELSE hash_algorithm END AS hash_algorithm,
CASE WHEN pixel_hash IS NULL THEN concat('/t/', id::VARCHAR) ELSE thumbnail_path END AS thumbnail_path FROM {files}""")
def update_hashes(spark, d):
    files = load(spark, d, "files")
    found = files.filter("pixel_hash IS NULL").select("id", F.concat(F.md5(F.col("path").cast("binary")), F.md5(F.col("id").cast("string").cast("binary"))).alias("pixel_hash"), F.concat(F.lit("/t/"), F.col("id").cast("string")).alias("thumbnail_path"))
    return catalog.set_hashes(files, found).select("id", "pixel_hash", "hash_algorithm", "thumbnail_path")


_OVER = "session_id = 1 AND expires_at < '2024-03-01' AND recovered_at IS NULL"


@query("SELECT b.id, CASE WHEN " + _OVER + " THEN '2024-07-09' ELSE recovered_at END AS recovered_at FROM {soft_deletes} b")
def delete_from_bin(spark, d):
    bin_ = load(spark, d, "soft_deletes").withColumn("trash_path", F.col("original_path"))
    return catalog.delete_for_good(bin_, bin_.filter(_OVER), "2024-07-09").select("id", "recovered_at")


@query("SELECT id, CASE WHEN expires_at < '2024-06-15' AND recovered_at IS NULL THEN '2024-06-15' ELSE recovered_at END AS recovered_at FROM {soft_deletes}")
def purge_bin(spark, d):
    return catalog.purge(load(spark, d, "soft_deletes"), "2024-06-15").select("id", "recovered_at")


@query("""WITH bin AS (SELECT id, id AS file_id, CASE WHEN id % 34 = 0 THEN '2024-01-01' END AS recovered_at FROM {files} WHERE status = 'deleted')
SELECT f.id, CASE WHEN b.id IS NOT NULL AND b.recovered_at IS NULL THEN 'active' ELSE status END AS status FROM {files} f LEFT JOIN bin b ON b.file_id = f.id""")
def restore_from_bin(spark, d):
    files = load(spark, d, "files")
    bin_ = files.filter("status = 'deleted'").select("id", F.col("id").alias("file_id"), F.when(F.col("id") % 34 == 0, "2024-01-01").alias("recovered_at"))
    return plan.restore(bin_, files, bin_.select("id"), "2024-07-09")[1].select("id", "status")


@query("SELECT id, CASE WHEN status = 'pending' AND session_id = 1 THEN 'cancelled' ELSE status END AS status FROM {requests}")
def cancel_requests(spark, d):
    requests = load(spark, d, "requests")
    return catalog.cancel_requests(requests, requests.filter("status = 'pending' AND session_id = 1")).select("id", "status")


@query("SELECT count(*) AS pending FROM {requests} WHERE session_id = 1 AND status = 'pending'")
def pending_requests(spark, d):
    return catalog.pending_requests(load(spark, d, "requests"), 1)


@query("SELECT p.id, p.username, count(r.id) AS files FROM {remote_peers} p LEFT JOIN {remote_files} r ON r.peer_id = p.id WHERE p.id <> 3 GROUP BY 1, 2")
def delete_peer(spark, d):
    peers, remote = catalog.delete_peer(load(spark, d, "remote_peers"), load(spark, d, "remote_files"), 3)
    n = remote.groupBy("peer_id").agg(F.count("*").alias("files"))
    return peers.join(n, peers.id == n.peer_id, "left").select("id", "username", F.coalesce("files", F.lit(0)).alias("files"))


@query("SELECT session_id, folder_path FROM {session_folders} UNION SELECT 1, regexp_replace(path, '/[^/]*$', '') FROM {files} WHERE session_id = 2")
def add_folders(spark, d):
    """A session is given the folders of the other one's files, and its own again."""
    folders, files = load(spark, d, "session_folders"), load(spark, d, "files").filter("session_id = 2")
    more = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder_path")).unionByName(folders.filter("session_id = 1").select("folder_path"))
    return catalog.add_folders(folders, 1, more)


@query("SELECT session_id, folder_path FROM {session_folders} WHERE NOT (session_id = 2 AND folder_path LIKE '/de/%')")
def remove_folders(spark, d):
    folders = load(spark, d, "session_folders")
    return catalog.remove_folders(folders, 2, folders.filter("folder_path LIKE '/de/%'").select("folder_path"))


@query("SELECT session_id, pixel_hash, target_peer, count(*) AS n FROM {requests} WHERE NOT (session_id = 1 AND status = 'denied') GROUP BY ALL HAVING (session_id, pixel_hash, target_peer) NOT IN (SELECT session_id, pixel_hash, target_peer FROM {requests} WHERE session_id = 1 AND status = 'denied')")
def delete_requests(spark, d):
    """All requests for what a session was denied are taken back."""
    requests = load(spark, d, "requests")
    left = peers.delete_requests(requests, requests.filter("session_id = 1 AND status = 'denied'"))
    return left.groupBy("session_id", "pixel_hash", "target_peer").agg(F.count("*").alias("n"))


@query("SELECT id, username, '2024-06-01' AS last_seen_at, 'now' AS file_mtime FROM {remote_peers} UNION ALL SELECT NULL, concat(username, '-2'), '2024-06-01', 'now' FROM {remote_peers}")
def upsert_peers(spark, d):
    """Every peer is seen again, twice, and with a new one each; the later sight counts."""
    known = load(spark, d, "remote_peers").withColumns({"last_seen_at": F.lit("2024-01-01"), "file_mtime": F.lit("then")})
    late = known.select("username", F.lit("2024-06-01").alias("last_seen_at"), F.lit("now").alias("file_mtime"), F.lit(2).alias("n"))
    early = late.withColumns({"last_seen_at": F.lit("2024-03-01"), "n": F.lit(1)})
    new = late.withColumn("username", F.concat("username", F.lit("-2")))
    return peers.upsert_peers(known, late.unionByName(early).unionByName(new), "n").select("id", "username", "last_seen_at", "file_mtime")


@query("SELECT id, username, NULL::VARCHAR AS last_seen_at, NULL::VARCHAR AS file_mtime FROM {remote_peers}")
def peers_list(spark, d):
    none = F.lit(None).cast("string")
    return peers.all_peers(load(spark, d, "remote_peers").withColumns({"last_seen_at": none, "file_mtime": none}))


@query("SELECT id, path, CASE WHEN status = 'active' AND pixel_hash IS NULL THEN 'deleted' ELSE status END AS status FROM {files} WHERE session_id = 1 UNION ALL SELECT id, concat('/moved', path), 'renamed' FROM {files} WHERE session_id = 2")
def update_status_and_path(spark, d):
    """Active files without a hash are deleted in one session; all files of the other move."""
    files = load(spark, d, "files")
    gone = catalog.set_status(files, files.filter("session_id = 1 AND status = 'active' AND pixel_hash IS NULL"), "deleted")
    return catalog.set_paths(gone, files.filter("session_id = 2").select("id", F.concat(F.lit("/moved"), "path").alias("path"))).select("id", "path", "status")


_CHOSEN = _DUPLICATES + f", chosen AS (SELECT id, CASE WHEN row_number() OVER (PARTITION BY pixel_hash ORDER BY {_CHAINS['KEEP_NEWEST']}, {_TIES}) = 1 THEN 'keep' ELSE 'delete' END AS action FROM dup)"


@query(_CHOSEN + " SELECT session_id, file_id, action FROM {file_actions} WHERE NOT (session_id = 1 AND file_id IN (SELECT id FROM dup)) UNION ALL SELECT 1, id, action FROM chosen")
def apply_preset(spark, d):
    return catalog.apply_preset(load(spark, d, "file_actions"), load(spark, d, "files"), 1, ranking.PRESETS["KEEP_NEWEST"])[0].select("session_id", "file_id", "action")


@query(_CHOSEN + " SELECT count(*) FILTER (action = 'keep') AS keep_count, count(*) FILTER (action = 'delete') AS delete_count FROM chosen")
def apply_preset_counts(spark, d):
    return catalog.apply_preset(load(spark, d, "file_actions"), load(spark, d, "files"), 1, ranking.PRESETS["KEEP_NEWEST"])[1]


# The log is folded one entry after the other here, by a recursion over each hash's entries with all its files as state.
_DECIDED = """WITH RECURSIVE steps AS (
  SELECT l.*, f.session_id, f.pixel_hash, coalesce(f.pixel_hash, 'file ' || f.id::VARCHAR) AS g, row_number() OVER (PARTITION BY f.session_id, coalesce(f.pixel_hash, 'file ' || f.id::VARCHAR) ORDER BY n) AS k
  FROM {decision_log} l JOIN {files} f ON f.id = l.file_id WHERE l.action IN ('keep', 'delete', 'ignore') AND l.scope IN ('file', 'folder')
), begins AS (
  SELECT f.session_id, coalesce(f.pixel_hash, 'file ' || f.id::VARCHAR) AS g, list({'id': f.id, 'active': f.status = 'active', 'action': a.action, 'scope': a.scope, 'at': a.decided_at, 'done': a.executed_at} ORDER BY f.id) AS state
  FROM {files} f LEFT JOIN {file_actions} a ON a.session_id = f.session_id AND a.file_id = f.id GROUP BY 1, 2
), walk(session_id, g, k, state) AS (
  SELECT session_id, g, 0::BIGINT, state FROM begins
  UNION ALL
  SELECT session_id, g, k, CASE WHEN asked = 'delete' AND had IS DISTINCT FROM asked AND hashed AND len(list_filter(state, lambda x: x.active AND x.action IS NULL)) = 1
    THEN list_transform(state, lambda x: CASE WHEN x.active AND x.action IS NULL THEN {'id': x.id, 'active': x.active, 'action': 'keep', 'scope': 'file', 'at': stamp, 'done': x.done} ELSE x END) ELSE state END
  FROM (
    SELECT w.session_id, w.g, s.k, s.action AS asked, s.pixel_hash IS NOT NULL AS hashed, s.decided_at AS stamp, list_filter(w.state, lambda x: x.id = s.file_id)[1].action AS had,
           list_transform(w.state, lambda x: CASE WHEN x.id <> s.file_id THEN x WHEN x.action = s.action THEN {'id': x.id, 'active': x.active, 'action': NULL, 'scope': NULL, 'at': NULL, 'done': NULL}
             ELSE {'id': x.id, 'active': x.active, 'action': s.action, 'scope': s.scope, 'at': s.decided_at, 'done': x.done} END) AS state
    FROM walk w JOIN steps s ON s.session_id = w.session_id AND s.g = w.g AND s.k = w.k + 1
  ) t
), ended AS (
  SELECT session_id, g, unnest(state) AS x FROM walk QUALIFY k = max(k) OVER (PARTITION BY session_id, g)
)"""


@query(_DECIDED + " SELECT session_id, x.id AS file_id, x.action AS action, x.scope AS scope, x.at AS decided_at, x.done AS executed_at FROM ended WHERE x.action IS NOT NULL")
def decision_log(spark, d):
    after = decisions.decide(load(spark, d, "file_actions"), load(spark, d, "files"), load(spark, d, "decision_log"))
    return after.select("session_id", "file_id", "action", "scope", "decided_at", "executed_at")


@query(_DECIDED + " SELECT session_id, g AS pixel_hash, x.id AS file_id, x.action AS action FROM ended WHERE x.action IS NOT NULL AND x.active AND g NOT LIKE 'file %' AND (session_id, g) IN (SELECT session_id, g FROM steps)")
def decision_answers(spark, d):
    files, log = load(spark, d, "files"), load(spark, d, "decision_log")
    return decisions.group_actions(decisions.decide(load(spark, d, "file_actions"), files, log), files, decisions.valid(log))
