"""The live scan, killed and resumed, and the stateful streams over several micro-batches and restarts."""

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import detectors, scan
from gleaner.streaming.drain import drained_in_parts

ARRIVAL = "session_id long, path string, size long, modified_at string, scanned_at string, text string"


def hashes(batch):
    return batch.withColumn("pixel_hash", F.md5(F.col("text").cast("binary"))).drop("text")


def arrive(spark, folder, rows):
    spark.createDataFrame([(1, p, len(t or ""), None, "now", t) for p, t in rows], ARRIVAL).coalesce(1).write.mode("append").parquet(folder)


def test_a_killed_scan_resumes_and_commits_every_file_once(spark, tmp_path):
    given, folder = str(tmp_path / "in"), str(tmp_path / "catalog")
    stream = lambda: spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(given)
    arrive(spark, given, [(f"/a/{i}", f"text {i % 4}") for i in range(10)])
    arrive(spark, given, [("/a/3", "again"), ("/b/1", None), ("/b/0", "text 0")])
    broken = {"left": 1}

    def dies_once(batch):
        out = hashes(batch)
        if batch.filter("path = '/b/1'").count() and broken["left"]:
            broken["left"] = 0
            # the batch has written a part of its rows when it is killed
            out.select("session_id", "path").withColumn("id", F.lit(99).cast("long")).write.parquet(f"{folder}/files/batch=1")
            raise RuntimeError("killed")
        return out

    with pytest.raises(Exception, match="killed"):
        scan.live_scan(stream(), folder, dies_once).awaitTermination()
    scan.live_scan(stream(), folder, dies_once).awaitTermination()
    arrive(spark, given, [("/c/0", "new"), ("/a/0", "known")])
    scan.live_scan(stream(), folder, dies_once).awaitTermination()
    rows = scan.catalog(spark, folder).orderBy("id").collect()
    assert [(r.id, r.path) for r in rows] == [*((i + 1, f"/a/{i}") for i in range(10)), (11, "/b/0"), (12, "/b/1"), (13, "/c/0")]
    assert rows[11].pixel_hash is None and rows[10].pixel_hash == rows[0].pixel_hash
    assert scan.catalog(spark, folder, below=1).count() == 10


def test_each_hash_and_each_folder_is_told_once(spark):
    files = [(i, 1, f"/f{i % 3}/{i}", None if i == 11 else f"h{i % 5}") for i in range(15)]
    schema = "id long, session_id long, path string, pixel_hash string"
    parts = [spark.createDataFrame([files[i] for i in some], schema) for some in ([0, 3, 1], [6, 9, 12, 4, 7, 2], [10, 13, 5, 8, 11, 14])]
    firsts = drained_in_parts(parts, detectors.first_duplicates, "firsts").collect()
    assert sorted((r.pixel_hash, r.first_id, r.second_id) for r in firsts) == [("h0", 0, 5), ("h1", 1, 6), ("h2", 2, 7), ("h3", 3, 8), ("h4", 4, 9)]
    expected = spark.createDataFrame([("/f0", 5), ("/f1", 5), ("/f2", 5), ("/none", 2)], "folder string, pending long")
    done = drained_in_parts(parts, lambda s: detectors.finished_folders(s, expected), "done").collect()
    assert sorted(r.folder for r in done) == ["/f0", "/f1"]  # a file of /f2 failed


def test_first_duplicates_ask_the_state_once_per_share(spark, tmp_path, monkeypatch):
    """300 hashes in three shares: the state is asked by share and not by hash, and every second file is found at its place."""
    calls, plain = str(tmp_path / "calls"), detectors.SecondCopy

    class Noted(plain):
        def handleInputRows(self, key, rows, timers):
            with open(calls, "a") as f:
                f.write("x")
            yield from plain.handleInputRows(self, key, rows, timers)

    monkeypatch.setattr(detectors, "SecondCopy", Noted)
    # h0 to h99 come in both parts, h100 to h199 twice and more in the second, h200 to h299 once.
    rows = [(i, 1 + i % 2, f"h{i}") for i in range(100)] + [(1000 + i * 5 + k, 1 + i % 2, f"h{i}") for i in range(200) for k in range(5)] + [(5000 + i, 1, f"h{i}") for i in range(200, 300)]
    parts = [spark.createDataFrame(some, "id long, session_id long, pixel_hash string") for some in (rows[:100], rows[100:][::-1])]
    got = drained_in_parts(parts, lambda s: detectors.first_duplicates(s, shares=3), "firsts").collect()
    want = [(1 + i % 2, f"h{i}", i, 1000 + i * 5) for i in range(100)] + [(1 + i % 2, f"h{i}", 1000 + i * 5, 1001 + i * 5) for i in range(100, 200)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(open(calls).read()) <= 6
