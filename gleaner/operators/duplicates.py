"""Exact duplicates: candidates, groups, membership, folders, summaries.

All functions take the files table and give a lazy DataFrame. Filters sit
before the grouping, columns are pruned before it, and groups are counted by
one aggregation or window on (session_id, key), so each costs one shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.operators import ids


def active() -> Column:
    return F.col("status") == "active"


def hashed() -> Column:
    return F.col("pixel_hash").isNotNull()


def size_collisions(files: DataFrame, session: int) -> DataFrame:
    """Unhashed files whose size is shared in the session, whatever the status or hash of the others."""
    mine = files.filter((F.col("session_id") == session) & F.col("size").isNotNull())
    return _with_copies(mine, ["size"]).filter(F.col("pixel_hash").isNull()).drop("copies")


def size_collision_total(files: DataFrame, session: int) -> DataFrame:
    """How many files, hashed or not, share their size: the end of the progress bar."""
    sizes = files.filter((F.col("session_id") == session) & F.col("size").isNotNull()).groupBy("size").agg(F.count("*").alias("n"))
    return sizes.filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Per session, hash and algorithm: active hashed files, more than one."""
    return files.filter(active() & hashed()).groupBy("session_id", "pixel_hash", "hash_algorithm").agg(F.count("*").alias("file_count")).filter("file_count > 1")


def _filtered(files: DataFrame, session: int, date_from: str | None, date_to: str | None, extensions: list[str] | None) -> DataFrame:
    keep = (F.col("session_id") == session) & active() & hashed()
    if date_from:
        keep &= F.col("modified_at") >= date_from
    if date_to:
        keep &= F.col("modified_at") <= date_to
    if extensions:
        keep &= reduce(or_, [F.lower("path").like("%" + e.lower()) for e in extensions])
    return files.filter(keep)


def filtered_groups(files: DataFrame, session: int, date_from: str | None = None, date_to: str | None = None, extensions: list[str] | None = None, min_copies: int = 2, sort_by: str = "waste", descending: bool = True, limit: int = 0, offset: int = 0) -> DataFrame:
    """Duplicate groups after filters on their files, sorted and cut to a page.

    "waste" orders by the sum of sizes, as does an unknown order. Fewer than
    two copies are never asked for. Ties are broken by the hash.
    """
    groups = (
        _filtered(files, session, date_from, date_to, extensions)
        .groupBy("pixel_hash")
        .agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"), F.min("modified_at").alias("first_modified"), F.max("modified_at").alias("last_modified"), F.min(F.length("path")).alias("path_length"))
        .filter(F.col("file_count") >= max(2, min_copies))
    )
    by = {"copies": "file_count", "date": "last_modified", "path_length": "path_length"}.get(sort_by, "total_size")
    page = groups.orderBy(F.col(by).desc() if descending else F.col(by).asc(), "pixel_hash")
    if offset:
        page = page.offset(offset)
    return page.limit(limit) if limit else page


def filtered_group_count(files: DataFrame, session: int, min_copies: int = 2, **filters) -> DataFrame:
    f = {"date_from": None, "date_to": None, "extensions": None} | filters
    groups = _filtered(files, session, **f).groupBy("pixel_hash").agg(F.count("*").alias("n"))
    return groups.filter(F.col("n") >= max(2, min_copies)).agg(F.count("*").alias("total_count"))


def _with_copies(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, with how often ("copies"); a null in the key equals a null.

    Counts come from an aggregate with map-side combine. Dealing them out anew
    leaves both sides of the join behind shuffles of its own, so that the
    adaptive planner can split a key that holds a large share of the rows.
    """
    counts = rows.groupBy(*[F.col(c).alias(f"key_{c}") for c in key]).agg(F.count("*").alias("copies")).filter("copies > 1")
    dealt = counts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    on = [rows[c].eqNullSafe(F.col(f"key_{c}")) for c in key]
    return rows.join(dealt, on).select(*rows.columns, "copies")


def duplicate_files(files: DataFrame, session: int) -> DataFrame:
    """Active hashed files with at least one equal, with the number of equals."""
    return _with_copies(files.filter((F.col("session_id") == session) & active() & hashed()), ["pixel_hash", "hash_algorithm"])


def duplicate_ids(files: DataFrame, session: int) -> DataFrame:
    """pixel_hash, file_count, position (from 1), id: the files of each duplicate group by id, a row each.

    The rows are numbered over all groups in ranges, and a position is the
    distance from the group's first number, so no task holds a group.
    """
    rows = ids.numbered(duplicate_files(files, session).select("pixel_hash", "id"), ["pixel_hash", "id"])
    groups = rows.groupBy("pixel_hash").agg(F.min("number").alias("first"), F.count("*").alias("file_count"))
    return rows.join(groups, "pixel_hash").select("pixel_hash", "file_count", (F.col("number") - F.col("first") + 1).alias("position"), "id")


def folder_progress(files: DataFrame, session: int, folder: str) -> DataFrame:
    mine = files.filter((F.col("session_id") == session) & active() & paths.starts_like(F.col("path"), folder))
    return mine.agg(F.count("*").alias("total"), F.count("pixel_hash").alias("hashed"))


def fully_duplicated_folders(files: DataFrame, session: int) -> DataFrame:
    """Folders all of whose hashed active files have an equal in the session."""
    mine = files.filter((F.col("session_id") == session) & active() & hashed()).select(paths.parent(F.col("path")).alias("folder"), "pixel_hash")
    again = _with_copies(mine, ["pixel_hash"]).groupBy("folder").agg(F.count("*").alias("again"))
    return mine.groupBy("folder").agg(F.count("*").alias("files")).join(again, "folder").filter("files = again").select("folder", "files")


def recoverable(files: DataFrame, session: int) -> DataFrame:
    """Per duplicate group: bytes freed when the largest file stays; sizes of null and 0 do not count."""
    positive = F.when(F.col("size") > 0, F.col("size"))
    return duplicate_files(files, session).groupBy("pixel_hash", "hash_algorithm").agg(F.count("*").alias("file_count"), F.coalesce(F.sum(positive) - F.max(positive), F.lit(0)).alias("recoverable_bytes"))


def scan_summary(files: DataFrame, session: int, similarity_groups: DataFrame) -> DataFrame:
    groups = recoverable(files, session).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum("recoverable_bytes"), F.lit(0)).alias("recoverable_bytes"))
    total = files.filter(F.col("session_id") == session).agg(F.count("*").alias("total_files"))
    near = similarity_groups.filter(F.col("session_id") == session).agg(F.count("*").alias("similarity_groups"))
    return total.crossJoin(groups).crossJoin(near)  # one row each


def session_overview(sessions: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """The latest session with its numbers of folders and files."""
    latest = sessions.orderBy(F.desc("id")).limit(1)
    n_folders = folders.groupBy("session_id").agg(F.count("*").alias("folder_count"))
    n_files = files.groupBy("session_id").agg(F.count("*").alias("file_count"))
    joined = latest.join(n_folders, latest.id == n_folders.session_id, "left").drop("session_id").join(n_files, F.col("id") == n_files.session_id, "left")
    return joined.select("id", "name", "status", F.coalesce("folder_count", F.lit(0)).alias("folder_count"), F.coalesce("file_count", F.lit(0)).alias("file_count"))


def hash_totals(files: DataFrame, session: int) -> DataFrame:
    """Files of every status by hash; empty hashes do not count."""
    return files.filter((F.col("session_id") == session) & hashed() & (F.col("pixel_hash") != "")).groupBy("pixel_hash").agg(F.count("*").alias("total"))


def pending_folders(files: DataFrame, session: int) -> DataFrame:
    """Folders of the unhashed size collisions, deepest first, with what is left to do in each."""
    todo = size_collisions(files, session).groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("pending"))
    return todo.orderBy(F.desc(paths.depth(F.col("folder"))), "folder")


def group_page(files: DataFrame, session: int, offset: int, limit: int) -> DataFrame:
    """A page of groups by (hash, algorithm), each with its files nested, largest and latest first.

    The page is chosen from the counts; files of other groups are not moved.
    """
    mine = files.filter((F.col("session_id") == session) & active() & hashed())
    counts = mine.groupBy(F.col("pixel_hash").alias("h"), F.col("hash_algorithm").alias("a")).agg(F.count("*").alias("file_count")).filter("file_count > 1")
    page = F.broadcast(counts.orderBy("h", "a").offset(offset).limit(limit))  # of `limit` rows
    order = F.struct((-F.coalesce("size", F.lit(-1))).alias("o1"), F.col("id"), F.col("path"), F.col("size"), F.col("modified_at"))
    own = mine.join(page, mine.pixel_hash.eqNullSafe(F.col("h")) & mine.hash_algorithm.eqNullSafe(F.col("a")))
    nested = own.groupBy("pixel_hash", "hash_algorithm", "file_count").agg(F.sort_array(F.collect_list(order)).alias("files"))
    return nested.withColumn("files", F.transform("files", lambda f: f.dropFields("o1"))).orderBy("pixel_hash", "hash_algorithm")


def unreferenced_thumbnails(files: DataFrame) -> DataFrame:
    """Thumbnails of inactive files whose hash is not that of any active file.

    As NOT IN has it: one active file without a hash, in any session, and the
    result is empty; rows without a hash never qualify. The null test is one
    row; the rest is an ordinary anti-join, which needs no broadcast.
    """
    unknown = files.filter(active() & F.col("pixel_hash").isNull()).limit(1).agg(F.count("*").alias("unknown"))
    live = files.filter(active() & hashed()).select("pixel_hash")
    gone = files.filter(~active() & F.col("thumbnail_path").isNotNull() & hashed()).select("pixel_hash", "thumbnail_path")
    return gone.join(live, "pixel_hash", "left_anti").crossJoin(F.broadcast(unknown)).filter("unknown = 0").select("thumbnail_path").distinct()
