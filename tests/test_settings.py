"""Settings, optimised exports and texts for display."""

import pytest
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import paths
from gleaner.operators import config, peers
from gleaner.sources import exchange


@pytest.fixture(scope="module")
def empty(spark):
    return {t: spark.createDataFrame([], schemas.schema(t)) for t in ("app_config", "sync_config")}


def test_settings_merge_and_defaults(empty):
    app, sync = empty["app_config"], empty["sync_config"]
    assert config.app_settings(app, sync).first().asDict() == {"language": "auto", "theme": "dark", "max_scan_workers": 4, "perf_logging": False, "scan_delay_ms": 0}
    assert config.upsert(app, "app_config", {"nothing": 1}).count() == 0
    app = config.upsert(app, "app_config", {"language": "de"})
    app = config.upsert(app, "app_config", {"perf_logging": True, "id": 9})
    assert app.first().asDict() == {"id": 1, "language": "de", "theme": "system", "max_scan_workers": 0, "perf_logging": True}
    for bad in ({"max_scan_workers": 33}, {"max_scan_workers": -1}):
        with pytest.raises(ValueError):
            config.upsert(app, "app_config", bad)
    with pytest.raises(ValueError):
        config.upsert(sync, "sync_config", {"scan_delay_ms": 3})
    sync, why = config.save_sync(sync, " ann ", "", "hash_only")
    assert why is None and config.sync_settings(sync).first().asDict() == {"local_username": "ann", "gdrive_folder_id": "", "export_privacy": "hash_only", "sync_enabled": False}
    assert config.save_sync(sync, "a b", "", "hash_only")[1] == "invalid_username"
    assert config.save_sync(sync, "ann", "short", "hash_only")[1] == "invalid_folder_id"
    app2, sync2 = config.set_app_setting(app, sync, "scan_delay_ms", 7)
    assert config.app_settings(app2, sync2).first().scan_delay_ms == 7
    assert config.set_app_setting(app, sync, "theme", 5) == (app, sync) == config.set_app_setting(app, sync, "other", 5)


def test_optimised_export_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "LINE_ENTRIES", 3)
    hashes = ["a" * 32, "b" * 64]
    rows = [(i, 1, f"C:\\Pictures\\Trip\\{i}.jpg" if i % 2 else f"/x/{i}.jpg", i, None, hashes[i % 10 == 0], "active") for i in range(40)] + [(99, 1, "C:/Pictures/Trip", 1, None, hashes[0], "active"), (98, 1, "/n", 1, None, None, "active")]
    files = spark.createDataFrame(rows, "id long, session_id long, path string, size long, modified_at string, pixel_hash string, status string")
    for level in ("hash_only", "filename", "full_path"):
        exchange.write_optimised(files, 1, "me", "2024", str(tmp_path / level), level)
        back = exchange.read_optimised(spark, str(tmp_path / level), whole_documents=False)
        want = [(f"me:{r[0]}", r[5], r[3], r[2].replace("\\", "/") if level == "full_path" else None) for r in rows if r[5]]
        assert sorted(tuple(r) for r in back.select("remote_id", "pixel_hash", "size", "path").collect()) == sorted(want)
    lines = spark.read.json(str(tmp_path / "full_path")).collect()
    assert len(lines) > 4 and {r["_format"] for r in lines} == {"optimized_v1"} and lines[0]["_path_tokens"]["<R0>"] == "C:/Pictures/Trip"
    exchange.write_optimised(files.limit(0), 1, "me", "2024", str(tmp_path / "none"), "full_path")
    assert exchange.read_optimised(spark, str(tmp_path / "none"), whole_documents=False).count() == 0
    with pytest.raises(ValueError):
        exchange.write_optimised(files, 1, "a b", "2024", str(tmp_path / "bad"))


def test_outgoing_round_trip(spark, tmp_path):
    rows = [(1, 1, "a" * 32, "bob", "pending", "2024"), (2, 1, "b" * 32, "bob", "denied", "2024"), (3, 2, "c" * 32, "bob", "approved", "2024")]
    requests = spark.createDataFrame(rows, "id long, session_id long, pixel_hash string, target_peer string, status string, requested_at string")
    exchange.write_outgoing(requests, 1, "me", "2024", str(tmp_path / "out"))
    assert [tuple(r) for r in exchange.read_outgoing(spark, str(tmp_path / "out")).collect()] == [("me", "a" * 32, "bob", "pending", "2024")]


def test_unseen_exports(spark):
    listing = spark.createDataFrame([("ann", "1"), ("bob", "1"), ("cy", "2"), ("b b", "1")], "username string, file_mtime string")
    seen = spark.createDataFrame([("bob", "1"), ("cy", "1")], "username string, file_mtime string")
    assert [r.username for r in exchange.unseen(listing, seen, "ann").collect()] == ["cy"]
    assert peers.upsert_peers(spark.createDataFrame([(1, "bob", "1")], "id long, username string, file_mtime string"), listing.withColumn("at", F.lit(1)), "at").count() == 4


def test_texts(spark):
    one = spark.range(1)
    text = lambda c: one.select(c.alias("t")).first().t
    assert [text(paths.elapsed_text(F.lit(x))) for x in (0, 5049, 59_949, 65_000, 119_700)] == ["0.0s", "5.0s", "59.9s", "1m 5s", "1m 60s"]
    assert [text(paths.thousands_text(F.lit(x))) for x in (7, 999, 1000, 12_345)] == ["7", "999", "1.0k", "12.3k"]
    assert [text(paths.share_text(F.lit(x))) for x in (0.0, 0.125, 1.0)] == ["0%", "13%", "100%"]
    assert [text(paths.percent(F.lit(x), F.lit(y))) for x, y in ((1, 3), (5, 0))] == [33, 0]
    assert text(paths.ratio_text(F.lit(47_000_000), F.lit(3_200_000))) == "Compressed 47.0 MB → 3.2 MB (93% reduction)"
    assert text(paths.ratio_text(F.lit(0), F.lit(1))) == ""
