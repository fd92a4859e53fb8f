"""Strict import of peers' exports: one document per file, read in tasks under limits, errors as rows.

A document that fails stops no other: it gives an outcome with an error code
and no entries. Files beyond the limit of bytes are never read, and a gzipped
one is unpacked up to the limit only, so a task holds one bounded document.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.paths import HASH_FORM, USER_FORM
from gleaner.operators import ids, peers
from gleaner.sources.exchange import MOST_BYTES, MOST_ENTRIES
from gleaner.storage import written

#: What may be wrong with a document.
ERRORS = ("invalid_file_type", "file_too_large", "corrupt_gzip", "malformed_json", "not_an_object", "invalid_username", "missing_files", "too_many_entries", "checksum_mismatch")
ROW = "document string, kind string, username string, exported_at string, privacy_level string, error string, entries long, skipped long, sha256 string, position long, remote_id string, pixel_hash string, size long, modified_at string, filename string, path string, target_peer string, status string"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_KINDS = [pa.int64() if c.endswith(" long") else pa.string() for c in ROW.split(", ")]


class Refused(Exception):
    """Why a document is not imported: one of ERRORS."""


def _unpacked(content: bytes, most: int) -> bytes:
    try:
        raw = gzip.GzipFile(fileobj=io.BytesIO(content)).read(most + 1)
    except (OSError, EOFError, zlib.error):
        raise Refused("corrupt_gzip") from None
    if len(raw) > most:
        raise Refused("file_too_large")
    return raw


def _expanded(payload: dict) -> dict:
    """A document in short form, its entries nested by hash and its paths cut by tokens, in the plain form."""
    tokens = payload.get("_path_tokens") or {}
    long = {v: k for k, v in peers.SHORT.items()}
    entries = []
    for group in payload["files"]:
        for short in group["files"]:
            entry = {long.get(k, k): v for k, v in short.items()} | {"pixel_hash": group["h"]}
            token = re.match(r"<R\d+>", entry.get("path") or "")
            if token and token[0] in tokens:
                entry["path"] = tokens[token[0]] + entry["path"][token.end() :]
            entries.append(entry)
    return {k: v for k, v in payload.items() if not k.startswith("_")} | {"files": entries}


def _checked(content: bytes, packed: bool, most_bytes: int, most_entries: int) -> dict:
    raw = _unpacked(content, most_bytes) if packed else content
    if len(raw) > most_bytes:
        raise Refused("file_too_large")
    try:
        payload = json.loads(raw)
    except (ValueError, RecursionError):
        raise Refused("malformed_json") from None
    if not isinstance(payload, dict):
        raise Refused("not_an_object")
    if payload.get("_format"):
        try:
            payload = _expanded(payload)
        except (KeyError, TypeError, AttributeError):
            raise Refused("missing_files") from None
        if len(json.dumps(payload, ensure_ascii=False).encode(errors="surrogatepass")) > most_bytes:
            raise Refused("file_too_large")
    name = payload.get("username")
    if not name or not re.match(USER_FORM, str(name)):
        raise Refused("invalid_username")
    if not isinstance(payload.get("files"), list):
        raise Refused("missing_files")
    if len(payload["files"]) > most_entries:
        raise Refused("too_many_entries")
    return payload


def _text(value, most: int | None = None) -> str | None:
    return None if value is None else str(value).encode(errors="replace").decode()[:most]


def _parse(most_bytes: int, most_entries: int):
    """Rows (document, content) to rows of ROW: one of kind document for each, and its entries and requests if it is accepted."""

    def one(document: str, content: bytes) -> Iterator[dict]:
        outcome = {"document": document, "kind": "document", "entries": 0, "skipped": 0, "sha256": hashlib.sha256(content).hexdigest()}
        try:
            payload = _checked(content, document.endswith(".gz"), most_bytes, most_entries)
        except Refused as why:
            yield outcome | {"error": str(why)}
            return
        head = {"document": document, "username": str(payload["username"]), "exported_at": _text(payload.get("exported_at")), "privacy_level": _text(payload.get("privacy_level"))}
        sound = lambda e: isinstance(e, dict) and e.get("pixel_hash") and re.match(HASH_FORM, str(e["pixel_hash"]))
        good = [(i, e) for i, e in enumerate(payload["files"]) if sound(e)]
        yield outcome | head | {"entries": len(good), "skipped": len(payload["files"]) - len(good)}
        for i, e in good:
            size = e.get("size")
            yield head | {
                "kind": "entry", "position": i, "remote_id": _text(e.get("remote_id")), "pixel_hash": str(e["pixel_hash"]), "size": size if isinstance(size, int) and abs(size) < 1 << 63 else None,
                "modified_at": _text(e.get("modified_at")), "filename": _text(e.get("filename"), peers.NAME_LENGTH), "path": _text(e.get("path"), peers.NAME_LENGTH),
            }
        asked = payload.get("requests_outgoing")
        for i, r in enumerate(asked if isinstance(asked, list) else []):
            if sound(r):
                yield head | {"kind": "request", "position": i, "pixel_hash": str(r["pixel_hash"]), "target_peer": _text(r.get("target_peer")), "status": _text(r.get("status")), "modified_at": _text(r.get("requested_at"))}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in zip(_NAMES, _KINDS, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for i in range(given.num_rows):  # one document at a time
                rows = []
                for row in one(given.column("document")[i].as_py(), given.column("content")[i].as_py()):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def listing(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """document, name, username (by its name), file_mtime and length of the files under `where`; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(where).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return files.select(F.col("path").alias("document"), name.alias("name"), F.regexp_replace(name, r"\.json(\.gz)?$", "").alias("username"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("file_mtime"), "length")


def read_documents(spark: SparkSession, where: str | list[str], most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES, checksums: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of all files under `where`: outcomes, entries, requests.

    outcomes has a row per file: document, username, exported_at,
    privacy_level, error (one of ERRORS, or null), entries, skipped (entries
    without a well-formed hash), sha256. checksums (document, sha256): what
    gzipped files must have. A file of no bytes has no row, as Spark's readers
    pass over it.
    """
    listed = listing(spark, where)
    fits = F.col("name").rlike(r"\.json(\.gz)?$")
    refused = listed.filter(~fits | (F.col("length") > most_bytes)).select("document", F.when(~fits, "invalid_file_type").otherwise("file_too_large").alias("error"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(where)
    # The filters on name and length come before the content is read.
    small = raw.filter((F.col("length") <= most_bytes) & F.col("path").rlike(r"\.json(\.gz)?$")).select(F.col("path").alias("document"), "content")
    rows = written(small.mapInArrow(_parse(most_bytes, most_entries), ROW), "documents")
    own = ("document", "username", "exported_at", "privacy_level")
    outcomes = rows.filter("kind = 'document'").select(*own, "error", "entries", "skipped", "sha256")
    if checksums is not None:
        expected = checksums.select("document", F.col("sha256").alias("expected"))
        bad = (F.col("expected") != F.col("sha256")) & F.col("document").endswith(".gz")
        joined = outcomes.join(expected, "document", "left").withColumn("bad", F.coalesce(bad, F.lit(False)))
        outcomes = written(joined.select(*own, F.when(F.col("bad"), "checksum_mismatch").otherwise(F.col("error")).alias("error"), *[F.when(F.col("bad"), 0).otherwise(F.col(c)).alias(c) for c in ("entries", "skipped")], "sha256"), "outcomes")
        rows = rows.join(outcomes.filter("error = 'checksum_mismatch'").select("document"), "document", "left_anti")
    entries = rows.filter("kind = 'entry'").select(*own, "position", "remote_id", "pixel_hash", "size", "modified_at", "filename", "path")
    requests = rows.filter("kind = 'request'").select(*own, "pixel_hash", "target_peer", "status", F.col("modified_at").alias("requested_at"))
    return outcomes.unionByName(refused, allowMissingColumns=True), entries, requests


def changed(listed: DataFrame, peers_seen: DataFrame, own: str) -> DataFrame:
    """Of a listing: exports by well-formed peers other than oneself whose time differs from that last seen (username, file_mtime)."""
    fit = listed.filter(F.col("name").rlike(r"\.json(\.gz)?$") & F.col("username").rlike(USER_FORM) & (F.col("username") != own))
    return fit.join(peers_seen.select("username", "file_mtime"), ["username", "file_mtime"], "left_anti")


def download(spark: SparkSession, where: str, peers_seen: DataFrame, own: str, checksums: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """outcomes and entries of the exports in a folder that changed since they were seen; outcomes have file_mtime and peer (by the file's name).

    The names of the changed files go to the driver, which lists the folder anyhow.
    """
    new = written(changed(listing(spark, where), peers_seen, own), "changed")
    names = [r["document"] for r in new.select("document").collect()]
    if not names:
        none = spark.createDataFrame([], ROW)
        return none.select("document", "username", "exported_at", "privacy_level", "error", "entries", "skipped", "sha256", F.lit("").alias("file_mtime"), F.lit("").alias("peer")), none.select("document", "username", "exported_at", "privacy_level", "position", "remote_id", "pixel_hash", "size", "modified_at", "filename", "path")
    outcomes, entries, _ = read_documents(spark, names, checksums=checksums, **limits)
    return outcomes.join(new.select("document", "file_mtime", F.col("username").alias("peer")), "document"), entries


def import_peers(known: DataFrame, remote: DataFrame, outcomes: DataFrame, entries: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """remote_peers and remote_files after an import: each accepted peer's files are replaced, new peers get ids.

    Of several documents of one peer the one exported last counts (then the
    last by name). Peers whose documents fail keep what they had.
    """
    order = [F.desc_nulls_last("exported_at"), F.desc("document")]
    good = outcomes.filter("error IS NULL").withColumn("place", F.row_number().over(Window.partitionBy("username").orderBy(*order))).filter("place = 1")
    taken = written(good.select("document", "username", *[c for c in ("file_mtime",) if c in outcomes.columns]), "taken")
    fresh = ids.with_ids(taken.select("username").join(known.select("username"), "username", "left_anti"), ["username"], known).select("id", "username")
    whole = known.unionByName(fresh, allowMissingColumns=True)
    seen = taken.select("username", F.lit(now).alias("last_seen_at"), *[F.col(c) for c in ("file_mtime",) if c in taken.columns]).withColumn("seen", F.lit(True))
    joined = whole.join(seen.withColumnsRenamed({c: f"new_{c}" for c in ("last_seen_at", "file_mtime")}), "username", "left")
    put = {c: F.when(F.col("seen"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("last_seen_at", "file_mtime") if c in known.columns and f"new_{c}" in joined.columns}
    after = written(joined.withColumns(put).select(*known.columns), "peers")
    owners = taken.join(after.select("username", F.col("id").alias("peer_id")), "username").select("document", "peer_id")
    columns = [c for c in remote.columns if c not in ("id", "peer_id")]
    rows = entries.join(owners, "document").select("document", "position", "peer_id", *[c for c in columns if c in entries.columns])
    added = ids.with_ids(rows, ["document", "position"], remote).drop("document", "position")
    kept = remote.join(owners.select("peer_id"), "peer_id", "left_anti").select(*remote.columns)
    return after, kept.unionByName(added, allowMissingColumns=True)
