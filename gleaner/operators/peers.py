"""Catalogs of peers: matches, what only peers have, requests, exchange rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.operators.plan import latest, merge

#: Fixed value: characters of a name or path that an import keeps.
NAME_LENGTH = 1024


def _local(files: DataFrame, session: int) -> DataFrame:
    return files.filter((F.col("session_id") == session) & (F.col("status") == "active") & F.col("pixel_hash").isNotNull())


def matches(files: DataFrame, remote: DataFrame, peers: DataFrame, session: int) -> DataFrame:
    """Every pair of a local active file and a remote one of the same hash."""
    mine = _local(files, session).select(F.col("id").alias("file_id"), F.col("path").alias("local_path"), "pixel_hash")
    theirs = remote.select("peer_id", "pixel_hash", F.col("filename").alias("remote_filename"), F.col("size").alias("remote_size"))
    names = peers.select(F.col("id").alias("peer_id"), "username")
    return mine.join(theirs, "pixel_hash").join(names, "peer_id").select("file_id", "local_path", "pixel_hash", "username", "remote_filename", "remote_size")


def _only_there(files: DataFrame, remote: DataFrame, session: int) -> DataFrame:
    return remote.join(_local(files, session).select("pixel_hash").distinct(), "pixel_hash", "left_anti")


def treasures(files: DataFrame, remote: DataFrame, peers: DataFrame, session: int) -> DataFrame:
    """Remote rows whose hash no local active file has, by user and name."""
    names = peers.select(F.col("id").alias("peer_id"), "username")
    return _only_there(files, remote, session).join(names, "peer_id").select("username", "filename", "pixel_hash", "size").orderBy("username", "filename")


def treasure_count(files: DataFrame, remote: DataFrame, session: int) -> DataFrame:
    return _only_there(files, remote, session).agg(F.count_distinct("pixel_hash").alias("treasures"))


def export_rows(files: DataFrame, session: int, username: str, privacy: str = "hash_only") -> DataFrame:
    """What an export holds of each active hashed file; names and paths as the privacy level allows. remote_id is username:id."""
    if privacy not in ("hash_only", "filename", "full_path"):
        raise ValueError(f"unknown privacy level: {privacy}")
    columns = [F.concat(F.lit(f"{username}:"), F.col("id").cast("string")).alias("remote_id"), "pixel_hash", "size", "modified_at"]
    if "perceptual_hash" in files.columns:
        columns.append("perceptual_hash")
    if privacy != "hash_only":
        columns.append(paths.basename(F.col("path")).alias("filename"))
    if privacy == "full_path":
        columns.append("path")
    return _local(files, session).select(*columns)


def valid_entries(entries: DataFrame) -> DataFrame:
    """Imported entries with a well-formed hash, names cut to their longest."""
    ok = entries.filter(F.col("pixel_hash").cast("string").rlike(paths.HASH_FORM))
    return ok.withColumns({c: F.substring(c, 1, NAME_LENGTH) for c in ("filename", "path") if c in entries.columns})


def replace_catalog(remote: DataFrame, peer_id: int, entries: DataFrame) -> DataFrame:
    """Remote files with one peer's rows replaced."""
    return remote.filter(F.col("peer_id") != peer_id).unionByName(entries.withColumn("peer_id", F.lit(peer_id).cast("long")), allowMissingColumns=True)


def upsert_peers(peers: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    return merge(peers, latest(seen, ["username"], order), ["username"], keep=("id",))


#: Entries of one hash in a row, on average at most.
LINE_ENTRIES = 1000


def nested_by_hash(entries: DataFrame) -> DataFrame:
    """Rows of a hash and some LINE_ENTRIES of its entries in an array, one for most hashes; rows without a hash fall out."""
    rest = [c for c in entries.columns if c != "pixel_hash"]
    known = entries.filter(F.col("pixel_hash").isNotNull())
    lines = known.groupBy("pixel_hash").agg(F.ceil(F.count("*") / LINE_ENTRIES).alias("lines"))
    dealt = known.join(lines, "pixel_hash").withColumn("line", F.pmod(F.xxhash64(*rest), F.col("lines")))
    return dealt.groupBy("pixel_hash", "line").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("files")).drop("line")


def flat_entries(nested: DataFrame) -> DataFrame:
    return nested.select("pixel_hash", F.explode("files").alias("f")).select("pixel_hash", "f.*")


#: Short names of exported keys.
SHORT = {"pixel_hash": "h", "path": "p", "size": "s", "modified_at": "m", "filename": "f", "remote_id": "r", "perceptual_hash": "ph"}


def shorten(entries: DataFrame) -> DataFrame:
    return entries.withColumnsRenamed({k: v for k, v in SHORT.items() if k in entries.columns})


def lengthen(entries: DataFrame) -> DataFrame:
    return entries.withColumnsRenamed({v: k for k, v in SHORT.items() if v in entries.columns})


#: How many roots, how long at least, and the share of paths that one must stand for.
MOST_ROOTS, LEAST_ROOT, ROOT_SHARE = 8, 10, 0.3


def common_roots(files: DataFrame, share: float = ROOT_SHARE) -> DataFrame:
    """Directory prefixes that stand for much of the paths: token, root.

    A root is at least LEAST_ROOT long and is a proper prefix of at least
    max(2, share of all) paths; the longest MOST_ROOTS are taken.
    """
    slashed = files.select(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path"))
    n = slashed.agg(F.count("*").alias("paths"))
    parts = slashed.withColumn("parts", F.split("path", "/"))
    prefixes = parts.filter(F.size("parts") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("root"))
    counted = prefixes.filter(F.length("root") >= LEAST_ROOT).groupBy("root").agg(F.count("*").alias("times"))
    often = counted.crossJoin(F.broadcast(n)).filter(F.col("times") >= F.greatest(F.lit(2), F.floor(F.col("paths") * share)))
    top = often.orderBy(F.desc(F.length("root")), F.desc("times"), "root").limit(MOST_ROOTS)
    place = F.row_number().over(Window.orderBy(F.desc(F.length("root")), F.desc("times"), "root"))  # of at most MOST_ROOTS rows
    return top.select(F.concat(F.lit("<R"), (place - 1).cast("string"), F.lit(">")).alias("token"), "root", "times")


def tokenise(files: DataFrame, roots: list[tuple[str, str]]) -> DataFrame:
    """Paths with the first root that fits (longest first) replaced by its token; other paths stay as they are."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    out = F.col("path")
    for token, root in reversed(roots):
        fits = path.startswith(root + "/") | (path == root)
        out = F.when(fits, F.concat(F.lit(token), F.substr(path, F.lit(len(root) + 1)))).otherwise(out)
    return files.withColumn("path", out)


def detokenise(files: DataFrame, roots: list[tuple[str, str]]) -> DataFrame:
    """Paths with their token replaced by its root."""
    out = F.col("path")
    for token, root in roots:
        out = F.when(F.col("path").startswith(token), F.concat(F.lit(root), F.substr("path", F.lit(len(token) + 1)))).otherwise(out)
    return files.withColumn("path", out)


def outgoing(requests: DataFrame, session: int) -> DataFrame:
    """What an export tells of a session's open requests."""
    asked = requests.filter((F.col("session_id") == session) & F.col("status").isin("pending", "approved"))
    return asked.select("pixel_hash", "target_peer", "status", "requested_at")


def requests_of(requests: DataFrame, session: int) -> DataFrame:
    return requests.filter(F.col("session_id") == session).orderBy(F.desc("requested_at"), "id")


def to_review(requests: DataFrame, session: int) -> DataFrame:
    return requests.filter((F.col("session_id") == session) & (F.col("status") == "pending")).orderBy("requested_at", "id")


def incoming(requests: DataFrame, peer: str) -> DataFrame:
    """Of all sessions, latest first."""
    return requests.filter(F.col("target_peer") == peer).orderBy(F.desc("requested_at"), "id")


def is_requested(requests: DataFrame, session: int, pixel_hash: str) -> DataFrame:
    found = (F.col("session_id") == session) & (F.col("pixel_hash") == pixel_hash) & F.col("status").isin("pending", "approved")
    return requests.agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("requested"))


def respond(requests: DataFrame, ids: DataFrame, status: str, now: str) -> DataFrame:
    """Requests after an answer to these (id), with its time."""
    hit = F.coalesce(F.col("hit"), F.lit(False))
    answered = F.when(hit & F.lit(status in ("approved", "denied")), F.lit(now)).otherwise(F.col("responded_at"))
    fulfilled = F.when(hit & F.lit(status == "fulfilled"), F.lit(now)).otherwise(F.col("fulfilled_at"))
    joined = requests.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return joined.withColumns({"responded_at": answered, "fulfilled_at": fulfilled, "status": F.when(hit, status).otherwise(F.col("status"))}).select(*requests.columns)


def delete_requests(requests: DataFrame, gone: DataFrame) -> DataFrame:
    """Requests without those taken back (session_id, pixel_hash, target_peer)."""
    key = ["session_id", "pixel_hash", "target_peer"]
    return requests.join(gone.select(*key).distinct(), key, "left_anti").select(*requests.columns)


def all_peers(known: DataFrame) -> DataFrame:
    """Every peer by name, with when it was seen and the time of the file that it was read from."""
    return known.select("id", "username", "last_seen_at", "file_mtime").orderBy("username")


def create_requests(requests: DataFrame, new: DataFrame) -> DataFrame:
    """Requests with new ones, except those already there for (session, hash, peer)."""
    key = ["session_id", "pixel_hash", "target_peer"]
    fresh = new.dropDuplicates(key).join(requests.select(*key), key, "left_anti")
    return requests.unionByName(fresh, allowMissingColumns=True)
