"""Similarity groups as stored tables: built, merged with new files, reviewed and cleared; both tables are one version.

A version is a folder of the store with the tables `groups` and `members`; it
counts once its `done` table is written, so a job that is lost in between
leaves the version before in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import similarity
from gleaner.operators.graph import least_labels
from gleaner.storage import written

STATUSES = schemas.ALLOWED["similarity_groups", "status"]
GROUPS, MEMBERS = schemas.DDL["similarity_groups"], "group_id long, file_id long, distance int"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], GROUPS), spark.createDataFrame([], MEMBERS)


def _tables(members: DataFrame, session: int, created_at: str) -> tuple[DataFrame, DataFrame]:
    rows = members.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("member_count"))
    groups = rows.select("id", F.lit(session).cast("long").alias("session_id"), F.lit(created_at).alias("created_at"), F.lit("pending").alias("status"), "member_count", F.col("id").alias("representative_file_id"))
    return groups, members.select("group_id", "file_id", F.col("distance").cast("int").alias("distance"))


def build(files: DataFrame, session: int, created_at: str, groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the session's groups made anew; those of other sessions stay."""
    new = _tables(written(similarity.similarity_groups(files, session), "built-groups"), session, created_at)
    kept = clear(groups, members, session)
    return kept[0].unionByName(new[0]), kept[1].unionByName(new[1])


def merge_new(files: DataFrame, fresh: DataFrame, session: int, created_at: str, groups: DataFrame, members: DataFrame, threshold: int = similarity.THRESHOLD, chunk: int = similarity.CHUNK) -> tuple[DataFrame, DataFrame]:
    """Both tables after new files (fresh: id) came to those that they were made of: equal to build() over all of them.

    Only blocks of bits that a new hash is in are searched; what was linked
    before comes from the stored members. A group keeps its status and its
    date if it has the members that it had.
    """
    mine = written(similarity.with_hash(files, session).select("id", "pixel_hash", "perceptual_hash").filter("pixel_hash IS NOT NULL"), "hashed-files")
    new = fresh.select("id").distinct().withColumn("new", F.lit(True))
    # A hash is new if all of its files are; its representative is its first file.
    state = mine.join(new.hint("merge"), "id", "left").groupBy("pixel_hash").agg(F.min(F.struct("id", "perceptual_hash")).alias("first"), F.bool_and(F.coalesce("new", F.lit(False))).alias("new"))
    reps = written(state.select("pixel_hash", "first.id", "first.perceptual_hash", "new"), "merged-representatives")
    found = similarity.links_of_new(reps, threshold, chunk)
    own = groups.filter(F.col("session_id") == session)
    stored = members.join(own.select(F.col("id").alias("group_id"), "representative_file_id").hint("merge"), "group_id")
    hash_of = lambda name, to: mine.select(F.col("id").alias(name), F.col("pixel_hash").alias(to)).hint("merge")
    before = stored.join(hash_of("file_id", "a"), "file_id").join(hash_of("representative_file_id", "b"), "representative_file_id").filter("a <> b").select("a", "b").distinct()
    roots = least_labels(found.unionByName(before))
    joined = written(similarity.members_of(mine, reps, roots), "merged-groups")
    made, rows = _tables(joined, session, created_at)
    same = rows.join(members.select("group_id", "file_id").hint("merge"), ["group_id", "file_id"]).groupBy("group_id").agg(F.count("*").alias("same"))
    old = own.select(F.col("id").alias("old"), F.col("status").alias("old_status"), F.col("created_at").alias("old_at"), F.col("member_count").alias("old_count"))
    judged = made.join(old.hint("merge"), made.id == F.col("old"), "left").join(same.hint("merge"), made.id == F.col("group_id"), "left")
    unchanged = (F.col("same") == F.col("member_count")) & (F.col("old_count") == F.col("member_count"))
    kept = judged.withColumns({"status": F.when(unchanged, F.col("old_status")).otherwise(F.col("status")), "created_at": F.when(unchanged, F.col("old_at")).otherwise(F.col("created_at"))}).select(*made.columns)
    rest = clear(groups, members, session)
    return rest[0].unionByName(kept), rest[1].unionByName(rows)


def clear(groups: DataFrame, members: DataFrame, session: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without a session's groups."""
    gone = groups.filter(F.col("session_id") == session).select(F.col("id").alias("group_id"))
    return groups.filter(F.col("session_id") != session), members.join(gone.hint("merge"), "group_id", "left_anti")


def set_status(groups: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """groups with these (id) in a state of review."""
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    named = ids.select("id").distinct().withColumn("named", F.lit(True))
    return groups.join(named.hint("merge"), "id", "left").withColumn("status", F.when(F.col("named"), status).otherwise(F.col("status"))).select(*groups.columns)


def commit(folder: str, groups: DataFrame, members: DataFrame) -> int:
    """Writes both tables as the next version of the store and gives its number."""
    spark = groups.sparkSession
    number = version(spark, folder) + 1
    base = f"{folder.rstrip('/')}/version={number}"
    groups.write.mode("overwrite").parquet(f"{base}/groups")
    members.write.mode("overwrite").parquet(f"{base}/members")
    spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/done/{number}")
    return number


def version(spark: SparkSession, folder: str) -> int:
    """The number of the last whole version, 0 for none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    try:
        found = listed.load(f"{folder.rstrip('/')}/done").select(F.regexp_extract("path", r"/done/(\d+)/[^/]*$", 1).cast("int").alias("v")).agg(F.max("v")).first()[0]
    except Exception as e:  # the store has no version yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return found or 0


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of the last whole version."""
    number = version(spark, folder)
    if not number:
        return empty(spark)
    base = f"{folder.rstrip('/')}/version={number}"
    return spark.read.schema(GROUPS).parquet(f"{base}/groups"), spark.read.schema(MEMBERS).parquet(f"{base}/members")
