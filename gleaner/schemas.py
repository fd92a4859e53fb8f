"""Schemas of the catalog's tables, their version, and checks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1

#: The tables and their columns.
DDL = {
    "sessions": "id long, name string, created_at string, status string, similarity_enabled boolean",
    "session_folders": "session_id long, folder_path string",
    "files": "id long, session_id long, path string, size long, modified_at string, pixel_hash string, hash_algorithm string, thumbnail_path string, status string, scanned_at string, perceptual_hash string, width int, height int",
    "sync_config": "id long, local_username string, gdrive_folder_id string, gdrive_file_id string, sync_enabled boolean, export_privacy string, pending_export boolean, last_exported_at string, last_imported_at string, scan_delay_ms int, last_upload_sha256 string",
    "remote_peers": "id long, username string, last_seen_at string, file_mtime string",
    "remote_files": "id long, peer_id long, remote_id string, filename string, path string, size long, modified_at string, pixel_hash string",
    "app_config": "id long, language string, theme string, max_scan_workers int, perf_logging boolean",
    "file_actions": "id long, session_id long, file_id long, action string, scope string, decided_at string, executed_at string",
    "soft_deletes": "id long, session_id long, file_id long, original_path string, trash_path string, deleted_at string, expires_at string, recovered_at string",
    "requests": "id long, session_id long, pixel_hash string, target_peer string, status string, requested_at string, responded_at string, fulfilled_at string",
    "similarity_groups": "id long, session_id long, created_at string, status string, member_count long, representative_file_id long",
    "similarity_group_members": "id long, group_id long, file_id long, distance int",
}
VIEWS = ("duplicate_groups",)

#: What enumerated columns may hold.
ALLOWED = {
    ("sessions", "status"): ("in_progress", "paused", "complete", "stopped"),
    ("files", "hash_algorithm"): ("sha256", "xxh128"),
    ("files", "status"): ("active", "deleted", "renamed"),
    ("sync_config", "export_privacy"): ("hash_only", "filename", "full_path"),
    ("file_actions", "action"): ("keep", "delete", "ignore"),
    ("file_actions", "scope"): ("file", "folder"),
    ("requests", "status"): ("pending", "approved", "denied", "fulfilled", "cancelled"),
    ("similarity_groups", "status"): ("pending", "reviewed", "actioned"),
}
RANGES = {("sync_config", "scan_delay_ms"): (0, 20), ("app_config", "max_scan_workers"): (0, 32)}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def missing(tables: dict[str, DataFrame], views: tuple[str, ...] = VIEWS) -> list[str]:
    """What a catalog lacks, in the order of the schema; the messages are fixed values."""
    found = []
    for table, ddl in DDL.items():
        if table not in tables:
            found.append(f"Missing table: {table}")
            continue
        have = set(tables[table].columns)
        found += [f"Missing column: {table}.{c.split()[0]}" for c in ddl.split(", ") if c.split()[0] not in have]
    return found + [f"Missing view: {v}" for v in VIEWS if v not in views]


def valid(table: str) -> Column:
    """True for rows whose enumerated and bounded columns hold what they may; null passes."""
    ok = F.lit(True)
    for (t, c), values in ALLOWED.items():
        if t == table:
            ok = ok & (F.col(c).isNull() | F.col(c).isin(*values))
    for (t, c), (lo, hi) in RANGES.items():
        if t == table:
            ok = ok & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return ok


def split_valid(table: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and the rest."""
    return rows.filter(valid(table)), rows.filter(~valid(table))


def migrate(version: int, steps: dict[int, callable], tables: dict[str, DataFrame]) -> tuple[int, dict[str, DataFrame]]:
    """Apply the steps above version in order; a newer catalog than VERSION is refused."""
    if version > VERSION:
        raise ValueError(f"catalog version {version} is newer than {VERSION}")
    for step in range(version + 1, VERSION + 1):
        tables = steps.get(step, lambda t: t)(tables)
    return VERSION, tables
