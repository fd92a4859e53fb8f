"""EXIF orientation, hashes for what lacks them, the walk over folders, telemetry files."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import telemetry
from gleaner.sources import exchange, images, walk

INVERSE = {1: lambda a: a, 2: np.fliplr, 3: lambda a: np.rot90(a, 2), 4: np.flipud, 5: np.transpose, 6: lambda a: np.rot90(a, 1), 7: lambda a: np.rot90(a.T, 2), 8: lambda a: np.rot90(a, -1)}


def exif(number, order):
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 2)
    tiff += struct.pack(order + "HHII", 0x010F, 2, 4, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, number, 0) + struct.pack(order + "I", 0)
    return b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff


def save_jpeg(spark, pixels, path, segment=b""):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 10)
    for y in range(pixels.shape[0]):
        for x in range(pixels.shape[1]):
            image.setRGB(x, y, int(pixels[y, x]) * 0x10101)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    data = path.read_bytes()
    cut = 4 + int.from_bytes(data[4:6], "big")  # after APP0
    path.write_bytes(data[:cut] + segment + data[cut:])


def test_all_orientations_of_one_picture_have_one_pixel_hash(spark, tmp_path):
    # constant blocks of 8 x 8 survive the coding unchanged, however they are turned
    base = np.kron(np.array([[10, 60, 110, 160], [30, 200, 250, 90]], np.uint8), np.ones((8, 8), np.uint8))
    for o, turn in INVERSE.items():
        assert np.array_equal(images.UPRIGHT[o](turn(base)), base)
        save_jpeg(spark, turn(base), tmp_path / f"{o}.jpg", exif(o, "<" if o % 2 else ">"))
    save_jpeg(spark, base, tmp_path / "plain.JPG")
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff\xe1\x00")
    assert {r.path.rsplit("/", 1)[1]: r.orientation for r in images.orientations(spark, str(tmp_path)).collect()} == {f"{o}.jpg": o for o in range(2, 9)}
    upright = images.with_hashes(images.read_upright(spark, str(tmp_path))).filter("pixel_hash IS NOT NULL").collect()
    assert len(upright) == 9 and len({(r.pixel_hash, r.perceptual_hash, r.width, r.height) for r in upright}) == 1 and (upright[0].width, upright[0].height) == (32, 16)
    stored = images.with_hashes(images.read_images(spark, str(tmp_path))).filter("pixel_hash IS NOT NULL").collect()
    assert len({r.pixel_hash for r in stored}) == 8


@pytest.mark.parametrize("head", [b"", b"\xff\xd8", b"\xff\xd8\xff\xe1", b"\xff\xd8\xff\xe1\x00\x08Exif\0\0", exif(9, "<"), b"\xff\xd8" + exif(9, ">"), b"\xff\xd8" + exif(6, "<")[:20], b"GIF89a"])
def test_odd_heads_are_upright(head):
    assert images.orientation(head) == 1


def test_only_missing_hashes_are_computed(spark, tmp_path):
    for i in range(3):
        save_jpeg(spark, np.full((8, 16), 40 * i, np.uint8), tmp_path / f"{i}.jpg")
    at = lambda i: f"{tmp_path}/{i}.jpg"
    files = spark.createDataFrame([(0, 1, at(0), "kept", None, "active"), (1, 1, at(1), None, None, "active"), (2, 1, at(2), "h", "p", "active"), (3, 1, at(3), None, None, "active")], "id long, session_id long, path string, pixel_hash string, perceptual_hash string, status string")
    found = {r.id: r for r in images.missing_hashes(files, images.read_upright(spark, str(tmp_path)), 1).collect()}
    assert set(found) == {0, 1} and found[0].pixel_hash == "kept" and len(found[1].pixel_hash) == 32 and found[0].perceptual_hash and (found[1].width, found[1].height) == (16, 8)


def test_walk_prunes_links_and_tells_what_cannot_be_read(spark, tmp_path):
    root = tmp_path / "photos"
    for name in ("a.jpg", "deep/er/b.HEIC", "deep/c.txt", "x.jpeg.bak", "deep/d.JPEG"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 7)
    os.symlink(root / "deep", root / "linked")
    os.symlink(root / "deep", tmp_path / "linked root")
    os.symlink(root / "a.jpg", root / "deep" / "file link.jpg")
    os.symlink(root / "none.jpg", root / "deep" / "gone.jpg")
    files, errors = walk.walk(spark, [str(root), str(tmp_path / "missing"), str(root)], 4, "now")
    rows = {r.path[len(str(root)) + 1 :]: r for r in files.collect()}
    assert set(rows) == {"a.jpg", "deep/er/b.HEIC", "deep/d.JPEG", "deep/file link.jpg"}
    assert rows["a.jpg"].size == 7 and rows["a.jpg"].session_id == 4 and rows["a.jpg"].modified_at.startswith("20")
    told = {r.path: r.message for r in errors.collect()}
    assert set(told) == {str(tmp_path / "missing"), str(root / "deep" / "gone.jpg")} and told[str(tmp_path / "missing")].startswith("Folder unreachable")


def test_a_root_that_hangs_is_given_up():
    import time

    assert not walk.reaches("/", 0.05, look=lambda p: time.sleep(0.5))
    assert walk.reaches("/")


def test_walk_of_no_folder_and_of_an_empty_one(spark, tmp_path):
    for folders in ([], [str(tmp_path)]):
        files, errors = walk.walk(spark, folders, 1, "now")
        assert files.count() == errors.count() == 0


def test_live_telemetry_round_trip(spark, tmp_path):
    schema = "run_id long, noted_at timestamp, row_id long, stage string, files long, queued long"
    part = lambda rows: spark.createDataFrame(rows, "run_id long, row_id long, stage string, files long, queued long").withColumn("noted_at", F.timestamp_seconds("row_id"))
    for rows in ([(1, 1, "discovery", 3, 1), (1, 2, "hashing", 5, 2)], [(1, 3, "hashing", 9, 4)]):
        part(rows).select("run_id", "noted_at", "row_id", "stage", "files", "queued").write.mode("append").parquet(str(tmp_path / "in"))
        exchange.live_telemetry(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), telemetry.totals, schema).awaitTermination()
    footer = exchange.read_summaries(spark, str(tmp_path / "out/footer"), "run_id long, stage string, rows long, files long, queued long")
    assert sorted(map(tuple, footer.collect())) == [(1, "discovery", 1, 3, 1), (1, "hashing", 2, 9, 6)]
    assert exchange.read_telemetry(spark, str(tmp_path / "out/rows"), schema).count() == 3


def test_a_live_scan_of_images_equals_the_batch_result(spark, tmp_path):
    from gleaner.streaming import scan

    source, base = tmp_path / "in", np.kron(np.array([[10, 60], [200, 90]], np.uint8), np.ones((8, 8), np.uint8))
    (source / "sub").mkdir(parents=True)
    save_jpeg(spark, base, source / "a.jpg")
    save_jpeg(spark, np.rot90(base, 1), source / "sub" / "b.JPG", exif(6, ">"))
    (source / "bad.jpeg").write_bytes(b"no image")
    (source / "c.txt").write_bytes(b"text")
    scan.scan_images(spark, str(source), str(tmp_path / "catalog"), 3, "now", 2).awaitTermination()
    save_jpeg(spark, base.T, source / "d.jpg")
    scan.scan_images(spark, str(source), str(tmp_path / "catalog"), 3, "now", 2).awaitTermination()
    rows = {r.path.rsplit("/", 1)[1]: r for r in scan.catalog(spark, str(tmp_path / "catalog")).collect()}
    whole = {r.path.rsplit("/", 1)[1]: r for r in images.with_hashes(images.read_upright(spark, str(source))).collect()}
    assert set(rows) == {"a.jpg", "b.JPG", "bad.jpeg", "d.jpg"} and sorted(r.id for r in rows.values()) == [1, 2, 3, 4] and rows["d.jpg"].id == 4
    assert all((rows[n].pixel_hash, rows[n].perceptual_hash, rows[n].width, rows[n].height) == tuple(whole[n][c] for c in ("pixel_hash", "perceptual_hash", "width", "height")) for n in rows)
    assert rows["a.jpg"].pixel_hash == rows["b.JPG"].pixel_hash != rows["d.jpg"].pixel_hash and rows["bad.jpeg"].pixel_hash is None and rows["a.jpg"].session_id == 3
