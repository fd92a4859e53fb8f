"""Strict import: every error code, one bad file not failing the rest, limits, downloads, replaced catalogs."""

import gzip
import hashlib
import json

from gleaner.sources import imports

HASH = "0123456789abcdef" * 2


def document(name="ann", files=None, **more):
    return {"username": name, "exported_at": "2024-06-01", "privacy_level": "full_path", "files": [{"remote_id": f"{name}:1", "pixel_hash": HASH, "size": 5, "modified_at": "m", "filename": "f" * 2000, "path": "/p/f"}] if files is None else files} | more


def save(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else json.dumps(content).encode())
    return str(folder)


def outcome(rows):
    return {r.document.rsplit("/", 1)[1]: (r.username, r.error, r.entries, r.skipped) for r in rows.collect()}


def test_every_error_is_a_row_and_stops_no_other(spark, tmp_path):
    whole = gzip.compress(json.dumps(document("gus")).encode())
    folder = save(tmp_path / "docs", {
        "ann.json": document(files=[{"pixel_hash": HASH}, {"pixel_hash": "XYZ"}, "text", {"pixel_hash": HASH, "size": "9", "path": None}]), "deep/bob.json": document("bob"), "gus.json.gz": whole,
        "a.txt": b"x", "big.json": b" " * 3000, "bomb.json.gz": gzip.compress(b" " * 100_000), "cut.json.gz": whole[:-9], "noise.json.gz": b"no gzip", "tail.json.gz": whole + b"junk",
        "bad.json": b'{"username": ', "latin.json": b'{"username": "\xff"}', "list.json": [1], "text.json": "x", "noname.json": {"files": []}, "dots.json": document("a.b"), "long.json": document("a" * 65), "nofiles.json": {"username": "x"},
        "object.json": {"username": "x", "files": {}}, "many.json": document(files=[{"pixel_hash": HASH}] * 21), "number.json": document(7, files=[]),
    })
    outcomes, entries, _ = imports.read_documents(spark, folder, most_bytes=2600, most_entries=20)
    assert outcome(outcomes) == {
        "ann.json": ("ann", None, 2, 2), "bob.json": ("bob", None, 1, 0), "gus.json.gz": ("gus", None, 1, 0), "number.json": ("7", None, 0, 0),
        "a.txt": (None, "invalid_file_type", None, None), "big.json": (None, "file_too_large", None, None), "bomb.json.gz": (None, "file_too_large", 0, 0),
        **{f: (None, "corrupt_gzip", 0, 0) for f in ("cut.json.gz", "noise.json.gz", "tail.json.gz")}, **{f: (None, "malformed_json", 0, 0) for f in ("bad.json", "latin.json")},
        **{f: (None, "not_an_object", 0, 0) for f in ("list.json", "text.json")}, **{f: (None, "invalid_username", 0, 0) for f in ("noname.json", "dots.json", "long.json")},
        **{f: (None, "missing_files", 0, 0) for f in ("nofiles.json", "object.json")}, "many.json": (None, "too_many_entries", 0, 0),
    }
    rows = {(r.username, r.position): r for r in entries.collect()}
    assert set(rows) == {("ann", 0), ("ann", 3), ("bob", 0), ("gus", 0)}
    assert rows["ann", 3].size is None and len(rows["bob", 0].filename) == 1024 and rows["bob", 0].path == "/p/f"


def test_optimised_documents_and_requests(spark, tmp_path):
    short = {"username": "ann", "exported_at": "t", "privacy_level": "full_path", "_format": "optimized_v1", "_path_tokens": {"<R0>": "/home/ann/pictures"}, "files": [{"h": HASH, "files": [{"r": "ann:1", "s": 3, "p": "<R0>/a.jpg"}, {"r": "ann:2", "p": "/b.jpg"}]}]}
    folder = save(tmp_path / "docs", {"ann.json.gz": gzip.compress(json.dumps(short).encode()), "bob.json": document("bob", requests_outgoing=[{"pixel_hash": HASH, "target_peer": "ann", "status": "pending", "requested_at": "t"}, {"pixel_hash": "bad"}]), "cy.json": short | {"username": "cy", "files": [{"h": HASH}]}})
    outcomes, entries, requests = imports.read_documents(spark, folder)
    assert outcome(outcomes)["ann.json.gz"] == ("ann", None, 2, 0) and outcome(outcomes)["cy.json"] == (None, "missing_files", 0, 0)
    assert sorted((r.remote_id, r.size, r.path) for r in entries.filter("username = 'ann'").collect()) == [("ann:1", 3, "/home/ann/pictures/a.jpg"), ("ann:2", None, "/b.jpg")]
    assert [(r.username, r.pixel_hash, r.target_peer, r.status, r.requested_at) for r in requests.collect()] == [("bob", HASH, "ann", "pending", "t")]


def test_download_skips_what_is_known_and_tells_errors_by_peer(spark, tmp_path):
    packed = gzip.compress(json.dumps(document("gus")).encode())
    folder = save(tmp_path / "docs", {"me.json": document("me"), "ann.json": document("ann"), "gus.json.gz": packed, "hal.json.gz": packed, "b.c.json": document(), "old.json": document("old"), "sad.json": b"{", "x.txt": b""})
    listed = {r.username: r for r in imports.listing(spark, folder).collect()}
    seen = spark.createDataFrame([("old", listed["old"].file_mtime), ("ann", "another time")], "username string, file_mtime string")
    sums = spark.createDataFrame([(listed["gus"].document, hashlib.sha256(packed).hexdigest()), (listed["hal"].document, "0" * 64)], "document string, sha256 string")
    outcomes, entries = imports.download(spark, folder, seen, "me", sums)
    assert {r.peer: r.error for r in outcomes.collect()} == {"ann": None, "gus": None, "hal": "checksum_mismatch", "sad": "malformed_json"}
    assert sorted(r.username for r in entries.collect()) == ["ann", "gus"]
    none = imports.download(spark, folder, imports.listing(spark, folder).select("username", "file_mtime"), "me")
    assert none[0].count() == 0 and none[1].count() == 0


def test_an_import_replaces_its_peers_and_no_other(spark, tmp_path):
    folder = save(tmp_path / "docs", {"1.json": document("ann", exported_at="2024-06-01"), "2.json": document("ann", files=[{"pixel_hash": HASH, "remote_id": "late"}], exported_at="2024-07-01"), "3.json": document("new"), "4.json": {"username": "bob"}})
    known = spark.createDataFrame([(3, "ann", "before", "t"), (9, "bob", "before", "t")], "id long, username string, last_seen_at string, file_mtime string")
    remote = spark.createDataFrame([(50, 3, "old", HASH), (51, 9, "bobs", HASH)], "id long, peer_id long, remote_id string, pixel_hash string")
    outcomes, entries, _ = imports.read_documents(spark, folder)
    peers, files = imports.import_peers(known, remote, outcomes, entries, "now")
    assert sorted(map(tuple, peers.collect())) == [(3, "ann", "now", "t"), (9, "bob", "before", "t"), (10, "new", "now", None)]
    rows = sorted((r.id, r.peer_id, r.remote_id) for r in files.collect())
    assert rows[0] == (51, 9, "bobs") and {r[1:] for r in rows} == {(9, "bobs"), (3, "late"), (10, "new:1")} and {r[0] for r in rows} == {51, 52, 53}
