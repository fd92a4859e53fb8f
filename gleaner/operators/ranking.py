"""Keepers: composable sort chains, presets, master copies, recommendations.

Each ranks the rows of a group by one window; ties end in explicit keys so
that every run picks the same file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import paths


@dataclass(frozen=True)
class Criterion:
    field: str
    ascending: bool = False


def _down(field: str) -> Criterion:
    return Criterion(field)


def _up(field: str) -> Criterion:
    return Criterion(field, True)


#: The named chains.
PRESETS = {
    "KEEP_LARGEST_FILE": (_down("size"), _down("modified_at"), _up("path_depth")),
    "KEEP_HIGHEST_RESOLUTION": (_down("resolution"), _down("size"), _down("modified_at")),
    "KEEP_NEWEST": (_down("modified_at"), _down("size"), _up("path_depth")),
    "KEEP_OLDEST": (_up("modified_at"), _down("size"), _up("path_depth")),
    "KEEP_SHORTEST_PATH": (_up("path_depth"), _down("size"), _down("modified_at")),
    "KEEP_DEEPEST_PATH": (_down("path_depth"), _down("size"), _down("modified_at")),
}
SIMILARITY_PRESETS = tuple(p for p in PRESETS if p != "KEEP_DEEPEST_PATH")


def resolution() -> Column:
    return F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0)).cast("long")


def _number(field: str) -> Column:
    if field == "size":
        return F.coalesce(F.col("size"), F.lit(0)).cast("long")
    if field == "resolution":
        return resolution()
    if field == "path_depth":
        return paths.depth(F.col("path"))
    if field == "filename_length":
        return F.length(F.coalesce(paths.basename(F.col("path")), F.lit("")))
    raise ValueError(f"unknown sort field: {field}")


def order_of(chain: tuple[Criterion, ...]) -> list[Column]:
    """The chain as ascending sort expressions.

    A date that sorts down is compared by its negated code points, in an
    array: a missing date is the empty array, which comes first, and of two
    dates of which one begins with the other, the shorter comes first.
    """
    if not chain:
        raise ValueError("a chain needs a criterion")
    keys = []
    for c in chain:
        if c.field == "modified_at":
            text = F.coalesce(F.col("modified_at"), F.lit(""))
            points = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: -F.ascii(ch))
            keys.append(text.asc() if c.ascending else points.asc())
        else:
            n = _number(c.field)
            keys.append(n.asc() if c.ascending else n.desc())
    return keys


def duplicate_ties() -> list[Column]:
    return [F.col("size").desc_nulls_last(), F.col("modified_at").desc_nulls_last(), F.col("id").asc()]


def similarity_ties() -> list[Column]:
    return [F.col("distance").asc(), F.col("file_id").asc()]


def mark_keepers(files: DataFrame, group: list[str], chain: tuple[Criterion, ...], ties: list[Column]) -> DataFrame:
    """files with `action`: keep for the first of each group, delete for the others; lone files are left out."""
    each = Window.partitionBy(*group)
    ranked = files.withColumns({"in_group": F.count("*").over(each), "place": F.row_number().over(each.orderBy(*order_of(chain), *ties))})
    return ranked.filter("in_group > 1").withColumn("action", F.when(F.col("place") == 1, "keep").otherwise("delete")).drop("in_group", "place")


def apply_preset(duplicates: DataFrame, chain: tuple[Criterion, ...], hashes: list[str] | None = None) -> DataFrame:
    """id, pixel_hash, action of duplicate files; an empty list of hashes means none, None means all."""
    if hashes is not None:
        duplicates = duplicates.filter(F.col("pixel_hash").isin(*hashes) if hashes else F.lit(False))
    return mark_keepers(duplicates, ["pixel_hash"], chain, duplicate_ties()).select("id", "pixel_hash", "action")


def master_copies(duplicates: DataFrame) -> DataFrame:
    """Per hash the file of most bytes, then the latest date (none is earliest), then the least path."""
    order = [F.coalesce("size", F.lit(0)).desc(), F.coalesce("modified_at", F.lit("")).desc(), F.col("path").asc(), F.col("id").asc()]
    first = F.row_number().over(Window.partitionBy("pixel_hash").orderBy(*order))
    return duplicates.withColumn("place", first).filter("place = 1").select("pixel_hash", F.col("id").alias("master_id"))


def apply_similarity_preset(members: DataFrame, totals: DataFrame, chain: tuple[Criterion, ...]) -> DataFrame:
    """group_id, file_id, action, never deleting the last copy of a hash.

    members: group_id, member_count, file_id, distance and the file's columns.
    totals: pixel_hash, total over the session. Members other than keepers
    are numbered by hash over all groups (member_count down, group, distance,
    file); those numbered below the hash's total go, the last one stays.
    """
    marked = mark_keepers(members, ["group_id"], chain, similarity_ties())
    known = marked.join(totals, "pixel_hash", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    turn = Window.partitionBy("pixel_hash", "action").orderBy(F.desc("member_count"), "group_id", "distance", "file_id")
    r = F.row_number().over(turn)
    free = (F.col("total") <= 1) | F.col("pixel_hash").isNull()
    action = F.when(F.col("action") == "keep", "keep").when(free | (r <= F.col("total") - 1), "delete").otherwise("keep")
    return known.select("group_id", "file_id", action.alias("final")).withColumnRenamed("final", "action")


def recommend(members: DataFrame, group: str) -> DataFrame:
    """Per group the keeper and why: strictly highest resolution, else strictly largest, else the best over all.

    For a lone file without resolution there is no reason (null).
    """
    order = [F.col("res").desc(), F.col("bytes").desc(), F.col("at").desc(), F.length("path").asc(), F.col("distance").asc(), F.col("file_id").asc()]
    base = members.withColumns({"res": resolution(), "bytes": F.coalesce("size", F.lit(0)), "at": F.coalesce("modified_at", F.lit(""))})
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = base.withColumn("place", place)
    first, rest = F.col("place") == 1, F.col("place") > 1
    found = ranked.groupBy(group).agg(
        F.max(F.when(first, F.col("file_id"))).alias("keeper_id"), F.max(F.when(first, F.col("res"))).alias("r1"), F.max(F.when(rest, F.col("res"))).alias("r2"),
        F.max(F.when(first, F.col("bytes"))).alias("b1"), F.max(F.when(rest, F.col("bytes"))).alias("b2"),
    )
    lone = F.col("r2").isNull()
    reason = (
        F.when((F.col("r1") > 0) & (lone | (F.col("r1") > F.col("r2"))), "highest resolution")
        .when(lone, F.lit(None))
        .when(F.col("b1") > F.col("b2"), "largest file")
        .otherwise("best overall")
    )
    return found.select(group, "keeper_id", reason.alias("reason"))


def keep_and_delete_others(keep_id: int, ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("file_id"), F.when(F.col("id") == keep_id, "keep").otherwise("delete").alias("action"))


def keep_one_of_each(keepers: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """file_id, action of the members (group, id) of whole groups: keep for those in keepers (id), delete for the others; groups without a keeper are left alone."""
    marked = members.select(group, "id").join(keepers.select("id").distinct().withColumn("keeps", F.lit(True)), "id", "left")
    groups = marked.filter("keeps").select(group).distinct()
    return marked.join(groups, group, "left_semi").select(F.col("id").alias("file_id"), F.when(F.col("keeps"), "keep").otherwise("delete").alias("action"))


def last_undecided(files: DataFrame, actions: DataFrame) -> DataFrame:
    """Active files that are the only one of their session and hash without an action there: they are kept."""
    decided = actions.select("session_id", F.col("file_id").alias("id"), "action")
    joined = files.filter((F.col("status") == "active") & F.col("pixel_hash").isNotNull()).join(decided, ["session_id", "id"], "left")
    open_ = F.count_if(F.col("action").isNull()).over(Window.partitionBy("session_id", "pixel_hash"))
    return joined.withColumn("open", open_).filter("open = 1 AND action IS NULL").select("session_id", "id", "pixel_hash", F.lit("keep").alias("action"))
