"""Changes of the catalog as table functions: each takes old tables and gives new ones, one shuffle on the key at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import paths
from gleaner.operators import duplicates, plan, ranking
from gleaner.operators.ranking import Criterion

#: Tables whose rows go with their session.
OF_SESSION = ("session_folders", "files", "file_actions", "requests", "similarity_groups")


def create_session(sessions: DataFrame, name: str, created_at: str) -> DataFrame:
    """sessions with a new one in progress, its id above all others."""
    new = sessions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(name).alias("name"), F.lit("in_progress").alias("status"), F.lit(created_at).alias("created_at"))
    return sessions.unionByName(new, allowMissingColumns=True)


def set_session_status(sessions: DataFrame, session: int, status: str) -> DataFrame:
    if status not in schemas.ALLOWED["sessions", "status"]:
        raise ValueError(f"unknown status: {status}")
    return sessions.withColumn("status", F.when(F.col("id") == session, status).otherwise(F.col("status")))


def delete_session(tables: dict[str, DataFrame], session: int) -> dict[str, DataFrame]:
    """The tables without a session and what belongs to it; refused while its bin holds rows, as they name the session."""
    if not tables["soft_deletes"].filter(F.col("session_id") == session).isEmpty():
        raise ValueError(f"the bin holds files of session {session}")
    left = {t: df.filter(F.col("session_id") != session) if t in OF_SESSION else df for t, df in tables.items()}
    left["sessions"] = tables["sessions"].filter(F.col("id") != session)
    if "similarity_group_members" in tables:
        gone = tables["similarity_groups"].filter(F.col("session_id") == session).select(F.col("id").alias("group_id"))
        left["similarity_group_members"] = tables["similarity_group_members"].join(gone, "group_id", "left_anti")
    return left


def add_folders(folders: DataFrame, session: int, paths_: DataFrame) -> DataFrame:
    """session_folders with these (folder_path) of a session; those that it has stay once."""
    key = ["session_id", "folder_path"]
    new = paths_.select(F.lit(session).cast("long").alias("session_id"), "folder_path").distinct()
    return folders.unionByName(new.join(folders.select(*key), key, "left_anti"), allowMissingColumns=True)


def remove_folders(folders: DataFrame, session: int, paths_: DataFrame) -> DataFrame:
    """session_folders without these (folder_path) of a session."""
    gone = paths_.select(F.lit(session).cast("long").alias("session_id"), "folder_path").distinct()
    return folders.join(gone, ["session_id", "folder_path"], "left_anti").select(*folders.columns)


def set_status(files: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """files with these (id) in a status."""
    if status not in schemas.ALLOWED["files", "status"]:
        raise ValueError(f"unknown status: {status}")
    return plan.merge(files, ids.select("id", F.lit(status).alias("status")).distinct(), ["id"]).join(files.select("id"), "id", "left_semi").select(*files.columns)


def set_paths(files: DataFrame, renamed: DataFrame) -> DataFrame:
    """files with these (id, path) under another path, as renamed."""
    changes = renamed.select("id", "path", F.lit("renamed").alias("status"))
    return plan.merge(files, changes, ["id"]).join(files.select("id"), "id", "left_semi").select(*files.columns)


def deactivate_folder(files: DataFrame, session: int, folder: str) -> DataFrame:
    """files with a session's files in a folder, whatever its depth, deleted; wildcards in folder are plain characters."""
    hit = (F.col("session_id") == session) & paths.under_escaped(F.col("path"), folder)
    return files.withColumn("status", F.when(hit, "deleted").otherwise(F.col("status")))


def set_hashes(files: DataFrame, updates: DataFrame) -> DataFrame:
    """files with pixel_hash, thumbnail_path and perceptual_hash, as far as updates (id, ...) has them; the algorithm follows the hash's length."""
    if "pixel_hash" in updates.columns:
        updates = updates.withColumn("hash_algorithm", paths.algorithm(F.col("pixel_hash")))
    return plan.merge(files, updates, ["id"]).join(files.select("id"), "id", "left_semi")


def delete_for_good(bin_: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """The bin after these items (id) left it for good: what has a file in the bin is marked as handled."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    marked = F.when(F.col("gone") & F.col("trash_path").isNotNull(), now).otherwise(F.col("recovered_at"))
    return bin_.join(gone, "id", "left").withColumn("recovered_at", marked).select(*bin_.columns)


def purge(bin_: DataFrame, now: str) -> DataFrame:
    """The bin after all items past their end, of every session, left it."""
    over = (F.col("expires_at") < now) & F.col("recovered_at").isNull()
    return bin_.withColumn("recovered_at", F.when(over, now).otherwise(F.col("recovered_at")))


def cancel_requests(requests: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    return requests.join(gone, "id", "left").withColumn("status", F.when(F.col("gone"), "cancelled").otherwise(F.col("status"))).select(*requests.columns)


def pending_requests(requests: DataFrame, session: int) -> DataFrame:
    return requests.filter((F.col("session_id") == session) & (F.col("status") == "pending")).agg(F.count("*").alias("pending"))


def delete_peer(peers: DataFrame, remote: DataFrame, peer_id: int) -> tuple[DataFrame, DataFrame]:
    """Peers and remote files without a peer and its files."""
    return peers.filter(F.col("id") != peer_id), remote.filter(F.col("peer_id") != peer_id)


def apply_preset(actions: DataFrame, files: DataFrame, session: int, chain: tuple[Criterion, ...], hashes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions after a preset on a session's duplicates, and how many it keeps and deletes.

    Over all groups, decisions on duplicates are cleared first; for named
    hashes only those groups' decisions are replaced.
    """
    same = duplicates.duplicate_files(files, session)
    if hashes is None:
        actions = plan.clear_for(actions, same.select(F.col("id").alias("file_id")), session)
    chosen = ranking.apply_preset(same, chain, hashes).select(F.lit(session).cast("long").alias("session_id"), F.col("id").alias("file_id"), "action", F.lit("file").alias("scope"))
    n = lambda what: F.count_if(F.col("action") == what).alias(f"{what}_count")
    return plan.merge(actions, chosen, ["session_id", "file_id"]), chosen.agg(n("keep"), n("delete"))


def apply_similarity_preset(actions: DataFrame, files: DataFrame, members: DataFrame, session: int, chain: tuple[Criterion, ...], groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions after a preset on a session's similarity groups, and how many it keeps and deletes.

    members: group_id, member_count, file_id, distance and the file's columns.
    Over all groups, decisions on their files are cleared first; for named
    groups (group_id) only those groups' files are decided.
    """
    if groups is None:
        actions = plan.clear_for(actions, members.select("file_id"), session)
    else:
        members = members.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    found = ranking.apply_similarity_preset(members, duplicates.hash_totals(files, session), chain)
    chosen = found.select(F.lit(session).cast("long").alias("session_id"), "file_id", "action", F.lit("file").alias("scope"))
    n = lambda what: F.count_if(F.col("action") == what).alias(f"{what}_count")
    return plan.merge(actions, chosen, ["session_id", "file_id"]), chosen.agg(n("keep"), n("delete"))
