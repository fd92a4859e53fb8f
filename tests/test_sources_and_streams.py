"""Files, images, exchange documents, telemetry and streams, on files made here."""

import gzip
import json
import struct
import zlib

import numpy as np

from gleaner.sources import exchange, files, images
from gleaner.streaming import detectors


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_discovery_and_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "sub/b.heic", "sub/c.txt", "sub/d.jpeg"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    found = files.discover(spark, [str(tmp_path), str(tmp_path / "missing")], 3, "2024-01-01")
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in found.collect()) == [("a.JPG", 5), ("b.heic", 10), ("d.jpeg", 10)]
    empty = spark.createDataFrame([(41, 3, str(tmp_path / "a.JPG"), 1)], "id long, session_id long, path string, size long")
    once = files.ingest(empty, found)
    assert sorted(r.id for r in once.collect()) == [41, 42, 43]
    assert files.ingest(once, found).count() == 3
    assert files.discover(spark, ["/no/such/folder"], 1, "").count() == 0


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = np.kron(rng.integers(0, 256, (8, 8, 3), np.uint8), np.ones((8, 8, 1), np.uint8))
    b = np.clip(a.astype(int) + rng.integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    other = np.kron(rng.integers(0, 256, (8, 8, 3), np.uint8), np.ones((8, 8, 1), np.uint8))
    for name, x in (("a", a), ("copy", a), ("near", b), ("other", other)):
        (tmp_path / f"{name}.png").write_bytes(png(x))
    (tmp_path / "broken.png").write_bytes(png(a)[:60])
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in images.with_hashes(images.read_images(spark, str(tmp_path))).collect()}
    bits = lambda x, y: (int(got[x].perceptual_hash, 16) ^ int(got[y].perceptual_hash, 16)).bit_count()
    assert got["a"].pixel_hash == got["copy"].pixel_hash != got["near"].pixel_hash
    assert len(got["a"].pixel_hash) == 32 and got["a"].width == 64
    assert bits("a", "near") <= 8 < bits("a", "other")
    assert "broken" not in got or got["broken"].pixel_hash is None


HASHES = ("a" * 64, "b" * 32)


def test_exchange(spark, tmp_path):
    doc = {"username": "ann", "exported_at": "2024", "privacy_level": "full_path", "files": [
        {"remote_id": "1", "pixel_hash": HASHES[0], "size": 5, "filename": "f" * 2000}, {"remote_id": "2", "pixel_hash": "BAD"}, {"pixel_hash": HASHES[1]}]}
    (tmp_path / "ann.json").write_text(json.dumps(doc))
    entries, why = exchange.checked_import(spark, str(tmp_path / "ann.json"))
    assert why is None
    assert sorted((r.username, r.pixel_hash, len(r.filename or "")) for r in entries.collect()) == [("ann", HASHES[0], 1024), ("ann", HASHES[1], 0)]
    assert [exchange.checked_import(spark, p)[1] for p in ("", str(tmp_path / "x.txt"), str(tmp_path / "none.json"))] == ["no_file_provided", "invalid_file_type", "file_not_found"]
    short = {"username": "bob", "_format": "optimized_v1", "_path_tokens": {"<R0>": "C:/Pictures/Trip"}, "files": [{"h": HASHES[1], "files": [{"r": "7", "p": "<R0>/x.jpg", "s": 1}, {"r": "8", "p": "/y.jpg"}]}]}
    with gzip.open(tmp_path / "bob.json.gz", "wt") as f:
        json.dump(short, f)
    assert sorted(r.path for r in exchange.read_optimised(spark, str(tmp_path / "bob.json.gz")).collect()) == ["/y.jpg", "C:/Pictures/Trip/x.jpg"]
    rows = spark.createDataFrame([(1, 1, "/p/a.jpg", 3, "2024", HASHES[1], "active"), (2, 1, "/p/b.jpg", 3, None, None, "active")], "id long, session_id long, path string, size long, modified_at string, pixel_hash string, status string")
    exchange.write_export(rows, 1, "me", "2024", str(tmp_path / "out"), "filename", compressed=True)
    back = exchange.read_export(spark, str(tmp_path / "out")).collect()
    assert [(r.username, r.filename, r.path) for r in back] == [("me", "a.jpg", None)]


def test_telemetry_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('at,files\n1,5\n# note\n\n2,9\n# SUMMARY: {"files": 9}\n')
    assert [tuple(r) for r in exchange.read_telemetry(spark, str(tmp_path / "t.csv"), "at long, files long").collect()] == [(1, 5), (2, 9)]
    assert [r.files for r in exchange.read_summaries(spark, str(tmp_path / "t.csv"), "files long").collect()] == [9]


def test_streams(spark, tmp_path):
    schema = "session_id long, id long, pixel_hash string, path string"
    batches = [[(1, 5, "a", "/x/1"), (1, 6, "b", "/x/2")], [(1, 3, "a", "/y/1"), (1, 9, "a", "/y/2"), (1, 8, None, "/y/3")], [(1, 1, "a", "/z/1"), (2, 2, "b", "/z/2"), (1, 4, "b", "/z/3")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drained(df, name, mode):
        with detectors.rocks(spark):
            q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            q.awaitTermination(120)
        return spark.table(name).collect()

    got = drained(detectors.first_duplicates(read()), "firsts", "append")
    assert sorted((r.session_id, r.pixel_hash, r.first_id, r.second_id) for r in got) == [(1, "a", 5, 3), (1, "b", 6, 4)]
    expected = spark.createDataFrame([("/x", 2), ("/y", 3), ("/z", 3)], "folder string, pending long")
    done = drained(detectors.folder_progress(read(), expected), "folders", "complete")
    assert {r.folder: r.complete for r in done} == {"/x": True, "/y": False, "/z": True}
