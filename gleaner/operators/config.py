"""Settings: tables of one row, merged by name and read with defaults."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import paths

#: What is read where no row is there.
APP_DEFAULTS = {"language": "auto", "theme": "dark", "max_scan_workers": 4, "perf_logging": False}
SYNC_DEFAULTS = {"local_username": "", "gdrive_folder_id": "", "export_privacy": "filename", "sync_enabled": False}
#: What a new row holds where it is not told otherwise.
NEW_ROW = {
    "app_config": {"language": "auto", "theme": "system", "max_scan_workers": 0, "perf_logging": False},
    "sync_config": {"sync_enabled": False, "export_privacy": "hash_only", "pending_export": False, "scan_delay_ms": 0},
}


def upsert(config: DataFrame, table: str, changes: dict[str, object]) -> DataFrame:
    """The one row of settings with changes put in, or a new row of them; unknown names count for nothing.

    Refused where an enumerated or bounded column may not hold its value, and
    where the first row of sync_config has no user name.
    """
    known = {f.name: f.dataType for f in schemas.schema(table) if f.name != "id"}
    changes = {k: v for k, v in changes.items() if k in known}
    if not changes:
        return config
    for name, value in changes.items():
        if value is None:
            continue
        lo, hi = schemas.RANGES.get((table, name), (value, value))
        if value not in schemas.ALLOWED.get((table, name), (value,)) or not lo <= value <= hi:
            raise ValueError(f"{table}.{name} cannot be {value!r}")
    spark = config.sparkSession
    fields = {c: F.lit(v).cast(known[c]) for c, v in changes.items()}
    fresh = {c: F.lit(v).cast(known[c]) for c, v in NEW_ROW[table].items()} | fields
    kept = config.filter("id = 1")
    if table == "sync_config" and changes.get("local_username") is None and kept.isEmpty():
        raise ValueError("the first settings need local_username")
    missing = spark.range(1).select(F.lit(1).cast("long").alias("id"), *[fresh.get(c, F.lit(None).cast(t)).alias(c) for c, t in known.items()])
    return kept.withColumns(fields).unionByName(missing.join(kept.select("id"), "id", "left_anti"), allowMissingColumns=True)


def _read(config: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """One row: the settings' first row, or the defaults if there is none."""
    row = config.filter("id = 1").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in defaults])
    return row.select(*[F.when(F.col("rows") == 0, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in defaults.items()])


def app_settings(app_config: DataFrame, sync_config: DataFrame) -> DataFrame:
    """language, theme, max_scan_workers, perf_logging and scan_delay_ms in one row."""
    delay = sync_config.filter("id = 1").agg(F.coalesce(F.first("scan_delay_ms"), F.lit(0)).alias("scan_delay_ms"))
    return _read(app_config, APP_DEFAULTS).join(F.broadcast(delay))  # one row each


def sync_settings(sync_config: DataFrame) -> DataFrame:
    """User name, folder, privacy and whether sync is on, in one row; nulls read as defaults."""
    return _read(sync_config, SYNC_DEFAULTS).select(*[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in SYNC_DEFAULTS.items()])


#: Settings that may be set by name, and their types.
SETTABLE = {"language": str, "theme": str, "max_scan_workers": (int, float), "perf_logging": (bool, int), "scan_delay_ms": (int, float)}


def set_app_setting(app_config: DataFrame, sync_config: DataFrame, name: str, value: object) -> tuple[DataFrame, DataFrame]:
    """Both tables after one setting; an unknown name or a value of another type changes nothing."""
    if not isinstance(name, str) or name not in SETTABLE or not isinstance(value, SETTABLE[name]):
        return app_config, sync_config
    if name == "scan_delay_ms":
        return app_config, upsert(sync_config, "sync_config", {name: int(value)})
    return upsert(app_config, "app_config", {name: value}), sync_config


def save_sync(sync_config: DataFrame, username: str | None, folder_id: str | None, privacy: str) -> tuple[DataFrame, str | None]:
    """sync_config after the user's choices, or as it was and why: invalid_username, invalid_folder_id (fixed values). A folder turns sync on."""
    username, folder_id = (username or "").strip(), (folder_id or "").strip()
    if not re.match(paths.USER_FORM, username):
        return sync_config, "invalid_username"
    if folder_id and not re.match(paths.FOLDER_ID_FORM, folder_id):
        return sync_config, "invalid_folder_id"
    return upsert(sync_config, "sync_config", {"local_username": username, "gdrive_folder_id": folder_id or None, "export_privacy": privacy, "sync_enabled": bool(folder_id)}), None
