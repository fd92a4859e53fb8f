"""Exchange documents of peers, plain or gzipped JSON, and telemetry files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.paths import USER_FORM
from gleaner.operators import peers

#: Bytes and entries that an imported document may have.
MOST_BYTES, MOST_ENTRIES = 10 << 20, 100_000
ENTRY = "struct<remote_id:string,pixel_hash:string,size:long,modified_at:string,perceptual_hash:string,filename:string,path:string>"
DOCUMENT = f"username string, exported_at string, privacy_level string, files array<{ENTRY}>"
OUTGOING = "username string, requests_outgoing array<struct<pixel_hash:string,target_peer:string,status:string,requested_at:string>>"
OPTIMISED = "username string, exported_at string, privacy_level string, _format string, _path_tokens map<string,string>, files array<struct<h:string,files:array<struct<r:string,s:long,m:string,ph:string,f:string,p:string>>>>"


def write_export(files: DataFrame, session: int, username: str, now: str, path: str, privacy: str = "hash_only", compressed: bool = False) -> None:
    """A catalog as JSON lines: one header document and its entries, a line each, in parallel files.

    A catalog is exchanged as rows rather than as one document, so no task
    holds it whole; read_export takes either form.
    """
    if not re.match(USER_FORM, username):
        raise ValueError(f"bad username: {username}")
    rows = peers.export_rows(files, session, username, privacy)
    lines = rows.select(F.lit(username).alias("username"), F.lit(now).alias("exported_at"), F.lit(privacy).alias("privacy_level"), F.array(F.struct(*rows.columns)).alias("files"))
    lines.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def export_by_settings(files: DataFrame, sync_config: DataFrame, session: int, now: str, path: str, compressed: bool = False) -> None:
    """write_export() with the user name and the level of privacy that the settings have; where there are none, local_user and hash_only (fixed values)."""
    row = sync_config.select("local_username", "export_privacy").first()
    name, privacy = (row["local_username"], row["export_privacy"]) if row else (None, None)
    write_export(files, session, name or "local_user", now, path, privacy or "hash_only", compressed)


def write_outgoing(requests: DataFrame, session: int, username: str, now: str, path: str) -> None:
    """A session's open requests as JSON lines beside its export, read again by read_outgoing."""
    rows = peers.outgoing(requests, session)
    lines = rows.select(F.lit(username).alias("username"), F.lit(now).alias("exported_at"), F.array(F.struct(*rows.columns)).alias("requests_outgoing"))
    lines.write.mode("overwrite").json(path)


def read_outgoing(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """username and the open requests that exports tell of."""
    raw = spark.read.schema(OUTGOING).option("multiLine", whole_documents).json(path).filter(F.col("username").rlike(USER_FORM))
    return raw.select("username", F.explode("requests_outgoing").alias("r")).select("username", "r.*")


def read_export(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """username, exported_at and the well-formed entries of exports; whole_documents: one JSON document per file."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", whole_documents).json(path)
    ok = raw.filter(F.col("username").rlike(USER_FORM))
    entries = ok.select("username", "exported_at", F.explode("files").alias("f")).select("username", "exported_at", "f.*")
    return peers.valid_entries(entries)


#: Entries of one hash in a line of an optimised export, on average at most.
LINE_ENTRIES = 1000


def write_optimised(files: DataFrame, session: int, username: str, now: str, path: str, privacy: str = "hash_only", share: float = peers.ROOT_SHARE) -> None:
    """A catalog as gzipped JSON lines with short keys, entries nested by hash and tokens for path roots.

    A line holds one hash and about LINE_ENTRIES of its entries; a hash with
    more has several lines, so no row grows with the catalog. The roots are at
    most peers.MOST_ROOTS.
    """
    if not re.match(USER_FORM, username):
        raise ValueError(f"bad username: {username}")
    rows = peers.export_rows(files, session, username, privacy)
    tokens = F.lit(None).cast("map<string,string>")
    if privacy == "full_path":
        roots = [(r["token"], r["root"]) for r in peers.common_roots(rows, share).collect()]
        rows = peers.tokenise(rows, roots)
        if roots:
            tokens = F.create_map(*[F.lit(x) for pair in roots for x in pair])
    counts = rows.groupBy("pixel_hash").agg(F.ceil(F.count("*") / LINE_ENTRIES).alias("lines"))
    short = peers.shorten(rows.join(counts, "pixel_hash").withColumn("line", F.pmod(F.xxhash64("remote_id"), F.col("lines"))).drop("lines"))
    entry = F.struct(*[c for c in short.columns if c not in ("h", "line")])
    nested = short.groupBy("h", "line").agg(F.sort_array(F.collect_list(entry)).alias("files"))
    header = {"username": username, "exported_at": now, "privacy_level": privacy, "_format": "optimized_v1"}
    lines = nested.select(*[F.lit(v).alias(k) for k, v in header.items()], tokens.alias("_path_tokens"), F.array(F.struct("h", "files")).alias("files"))
    lines.write.mode("overwrite").option("compression", "gzip").json(path)


def read_optimised(spark: SparkSession, path: str, whole_documents: bool = True) -> DataFrame:
    """The entries of optimised exports, keys, hashes and paths whole again; whole_documents: one JSON document per file."""
    raw = spark.read.schema(OPTIMISED).option("multiLine", whole_documents).json(path).filter(F.col("username").rlike(USER_FORM))
    nested = raw.select("username", "exported_at", "_path_tokens", F.explode("files").alias("g")).select("username", "exported_at", "_path_tokens", "g.h", F.explode("g.files").alias("f"))
    token = F.regexp_extract("f.p", r"^(<R\d+>)", 1)
    root = F.element_at("_path_tokens", token)
    whole = F.when(root.isNull(), F.col("f.p")).otherwise(F.concat(root, F.substr("f.p", F.length(token) + 1)))
    return peers.valid_entries(nested.select("username", "exported_at", F.col("f.r").alias("remote_id"), F.col("h").alias("pixel_hash"), F.col("f.s").alias("size"), F.col("f.m").alias("modified_at"), F.col("f.ph").alias("perceptual_hash"), F.col("f.f").alias("filename"), whole.alias("path")))


def checked_import(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """Entries of one document, or why not: no_file_provided, invalid_file_type, file_not_found, file_too_large, too_many_entries."""
    if not path:
        return None, "no_file_provided"
    if not re.search(r"\.json(\.gz)?$", path):
        return None, "invalid_file_type"
    folder, _, name = path.rpartition("/")
    there = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder or ".").select("length").limit(1).collect()
    if not there:
        return None, "file_not_found"
    if there[0]["length"] > MOST_BYTES:
        return None, "file_too_large"
    if spark.read.schema(DOCUMENT).option("multiLine", True).json(path).agg(F.coalesce(F.sum(F.size("files")), F.lit(0))).first()[0] > MOST_ENTRIES:
        return None, "too_many_entries"
    return read_export(spark, path, whole_documents=True), None


def unseen(listing: DataFrame, peers_seen: DataFrame, own: str) -> DataFrame:
    """Of listed export files (username, file_mtime): well-formed, not one's own, changed since last seen."""
    named = listing.filter(F.col("username").rlike(USER_FORM) & (F.col("username") != own))
    return named.join(peers_seen.select("username", "file_mtime"), ["username", "file_mtime"], "left_anti")


def write_telemetry(rows: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """Telemetry rows as CSV with a header; summary (one row) follows as a file of one comment line, "# SUMMARY:" and its JSON."""
    rows.write.mode("overwrite").option("header", True).csv(path)
    if summary is not None:
        line = F.concat(F.lit("# SUMMARY:"), F.to_json(F.struct(*summary.columns)))
        summary.select(line.alias("value")).coalesce(1).write.mode("append").text(path)


def live_telemetry(rows: DataFrame, path: str, summarise: Callable[[DataFrame], DataFrame], schema: str) -> StreamingQuery:
    """Writes a stream of telemetry rows as it comes, batch by batch, and after each batch the summary over all so far.

    A batch that runs again writes over its own files. read_telemetry() and
    read_summaries() read what is there; the last summary is in footer/.
    """
    base = path.rstrip("/")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("header", True).csv(f"{base}/rows/batch={number}")
        known = read_telemetry(batch.sparkSession, f"{base}/rows", schema + ", batch int").filter(F.col("batch") <= number).drop("batch")
        summary = summarise(known)
        summary.select(F.concat(F.lit("# SUMMARY:"), F.to_json(F.struct(*summary.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{base}/footer")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()


def read_telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Telemetry rows; lines that begin with # and rows that are too short fall out."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").option("mode", "DROPMALFORMED").csv(path)


def read_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON after "# SUMMARY:" at the end of telemetry files; what is no JSON is left out."""
    lines = spark.read.text(path).filter(F.col("value").startswith("# SUMMARY:"))
    return lines.select(F.from_json(F.trim(F.substring("value", len("# SUMMARY:") + 1, 1 << 20)), schema).alias("s")).filter("s IS NOT NULL").select("s.*")
