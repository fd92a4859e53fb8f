"""The plan: decisions per file, their merges, summary, execution and the bin.

Tables are never changed in place. A merge takes the old table and the changes
and gives the new table, one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.operators import naming

RETENTION_DAYS = 30


def latest(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return changes.withColumn("place", place).filter("place = 1").drop("place", order)


def merge(old: DataFrame, changes: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with changes put in by key: columns of changes win, those in `keep` and those changes lack stay as they were."""
    theirs = changes.select(*[F.col(c).alias(f"new_{c}") for c in changes.columns]).withColumn("changed", F.lit(True))
    on = [old[k] == F.col(f"new_{k}") for k in key]
    joined = old.withColumn("there", F.lit(True)).join(theirs, on, "full_outer")

    def column(c: str) -> Column:
        if c not in changes.columns:
            return F.col(c)
        if c in keep:
            return F.when(F.col("there"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)
        return F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[column(c) for c in old.columns])


def upsert_actions(actions: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Decisions with later ones put in, the last per file winning; executed_at of what was there stays."""
    return merge(actions, latest(changes, ["session_id", "file_id"], order), ["session_id", "file_id"])


def clear_for(actions: DataFrame, file_ids: DataFrame, session: int) -> DataFrame:
    """Decisions without the session's on these files."""
    gone = file_ids.select(F.col("file_id")).distinct().withColumn("session_id", F.lit(session).cast("long"))
    return actions.join(gone, ["session_id", "file_id"], "left_anti")


def toggle(actions: DataFrame, changes: DataFrame) -> DataFrame:
    """Decisions after each change (one per file): the same action again clears it, another replaces it."""
    theirs = changes.select("session_id", "file_id", F.col("action").alias("asked"))
    joined = actions.select("session_id", "file_id", "action").join(theirs, ["session_id", "file_id"], "full_outer")
    after = F.when(F.col("asked").isNull(), F.col("action")).when(F.col("asked") == F.col("action"), F.lit(None)).otherwise(F.col("asked"))
    return joined.select("session_id", "file_id", after.alias("action")).filter("action IS NOT NULL")


def folder_action(files: DataFrame, actions: DataFrame, session: int, folder: str, action: str) -> DataFrame:
    """Decisions after `action` on all duplicates (over every status) below folder."""
    mine = files.filter((F.col("session_id") == session) & F.col("pixel_hash").isNotNull())
    shared = mine.groupBy("pixel_hash").agg(F.count("*").alias("copies")).filter("copies > 1").select("pixel_hash")
    hit = mine.filter(paths.under(F.col("path"), folder)).join(shared, "pixel_hash", "left_semi")
    changes = hit.select("session_id", F.col("id").alias("file_id"), F.lit(action).alias("action"), F.lit("folder").alias("scope"))
    return merge(actions, changes, ["session_id", "file_id"])


def pending(actions: DataFrame, session: int) -> DataFrame:
    return actions.filter((F.col("session_id") == session) & F.col("executed_at").isNull())


def summary(actions: DataFrame, files: DataFrame, session: int) -> DataFrame:
    """One row: pending deletions and their bytes, keeps, ignores, deletions by folder."""
    sizes = files.select(F.col("id").alias("file_id"), "size")
    joined = pending(actions, session).join(sizes, "file_id")
    n = lambda cond, value=1: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    is_delete = F.col("action") == "delete"
    return joined.agg(
        n(is_delete).alias("delete_count"), n(is_delete, F.col("size")).alias("delete_bytes"), n(F.col("action") == "keep").alias("keep_count"),
        n(F.col("action") == "ignore").alias("ignore_count"), n(is_delete & (F.col("scope") == "folder")).alias("folder_count"),
    )


def deletions(actions: DataFrame, files: DataFrame, session: int) -> DataFrame:
    """Pending deletions with path, size and hash ('' without one), by path."""
    what = files.select(F.col("id").alias("file_id"), "path", "size", F.coalesce("pixel_hash", F.lit("")).alias("pixel_hash"))
    return pending(actions, session).filter("action = 'delete'").select("file_id", "scope").join(what, "file_id").orderBy("path")


def review(actions: DataFrame, files: DataFrame, session: int) -> DataFrame:
    """The plan for review: a row per pending deletion, by path, with the plan's counts and bytes; one row without a file where nothing is to go."""
    counts = summary(actions, files, session).select("keep_count", "delete_count", "ignore_count", F.col("delete_bytes").alias("total_size_bytes"))
    rows = deletions(actions, files, session).select("file_id", "path", "size", "pixel_hash", F.lit("delete").alias("action"))
    return counts.join(rows, F.lit(True), "left").orderBy("path")  # counts is one row


def execute(actions: DataFrame, files: DataFrame, bin_: DataFrame, session: int, now: Column, trash: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the pending deletions: executed, in the bin, status deleted.

    A file is called by its flattened path; where another deletion or what lies
    in the session's bin has that name, by the first number of it that is free.
    """
    lying = bin_.filter((F.col("session_id") == session) & F.col("recovered_at").isNull()).select(paths.basename(F.col("trash_path")).alias("name"))
    todo = deletions(actions, files, session).select("file_id", "path")
    todo = todo.join(naming.free_names(todo, lying), "file_id")
    named = F.col("name")
    text = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    ends = F.date_format(now + F.expr(f"INTERVAL {RETENTION_DAYS} DAYS"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    gone = todo.select(F.lit(session).cast("long").alias("session_id"), "file_id", F.col("path").alias("original_path"), F.concat(F.lit(f"{trash}/{session}/"), named).alias("trash_path"), text.alias("deleted_at"), ends.alias("expires_at"), F.lit(None).cast("string").alias("recovered_at"))
    done = merge(actions, todo.select(F.lit(session).cast("long").alias("session_id"), "file_id", text.alias("executed_at")), ["session_id", "file_id"])
    status = merge(files, todo.select(F.col("file_id").alias("id"), F.lit("deleted").alias("status")), ["id"])
    return done, status, merge(bin_, gone, ["session_id", "file_id"], keep=("original_path",))


def in_bin(bin_: DataFrame, session: int) -> DataFrame:
    return bin_.filter((F.col("session_id") == session) & F.col("recovered_at").isNull()).orderBy(F.desc("deleted_at"), "id")


def expired(bin_: DataFrame, cutoff: str) -> DataFrame:
    """Rows of all sessions whose end, compared as text, lies before cutoff."""
    return bin_.filter((F.col("expires_at") < cutoff) & F.col("recovered_at").isNull())


def restore(bin_: DataFrame, files: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Bin and files after these items of the bin (id) came back; those that left it before stay as they are."""
    back = bin_.filter(F.col("recovered_at").isNull()).join(ids.select("id").distinct(), "id", "left_semi").select("id", "file_id")
    marked = merge(bin_, back.select("id", F.lit(now).alias("recovered_at")), ["id"])
    return marked, merge(files, back.select(F.col("file_id").alias("id"), F.lit("active").alias("status")).distinct(), ["id"])


def days_left(expires: Column, now: Column) -> Column:
    """Whole days, cut towards zero."""
    return F.timestamp_diff("DAY", now, expires)
