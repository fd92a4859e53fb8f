"""Ids of ingested files and names in the bin: unique, dense, and those of serving one file after the other."""

import itertools
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from gleaner.operators import naming, plan
from gleaner.sources import files as sources


def served_one_by_one(todo, lying):
    taken, names = set(lying), {}
    for path, file_id in sorted((p, i) for i, p in todo):
        flat = path.replace("/", "_").replace("\\", "_").replace(":", "_")
        stem, suffix = PurePosixPath(flat).stem, PurePosixPath(flat).suffix
        name = next(n for n in itertools.chain([flat], (f"{stem}_{k}{suffix}" for k in itertools.count(1))) if n not in taken)
        taken.add(name)
        names[file_id] = name
    return names


def named(spark, todo, lying):
    rows = naming.free_names(spark.createDataFrame(todo, "file_id long, path string"), spark.createDataFrame([(n,) for n in lying], "name string"))
    return {r.file_id: r.name for r in rows.collect()}


@pytest.mark.parametrize(
    "paths, lying",
    [
        (["/d/a.jpg", "/d_a.jpg", "/d/a_1.jpg"], []),
        (["/a", "_a", "/a_1", "_a_1", "/a_1_1", "_a_1_1"], []),
        (["/a.jpg", "_a.jpg", "/a_3.jpg"], ["_a.jpg", "_a_1.jpg", "_a_2.jpg", "_a_01.jpg", "_a_1_2.jpg"]),
        (["/.jpg", "_.jpg", "/a.", "_a.", "/x.y.z", "/x/y.z", "_x.y.z"], ["_a."]),
    ],
)
def test_names_of_the_bin(spark, paths, lying):
    todo = list(enumerate(paths))
    assert named(spark, todo, lying) == served_one_by_one(todo, lying)


def test_names_of_many_tangled_paths(spark):
    made = random.Random(4)
    paths = {"".join(made.choice(["/", "_", "a", "_1", "_2", ".j"]) for _ in range(made.randint(1, 5))) for _ in range(250)}
    todo = list(enumerate(sorted(paths, key=lambda p: made.random())))
    lying = {"".join(made.choice(["_", "a", "_1", "_2", ".j"]) for _ in range(made.randint(1, 4))) for _ in range(60)}
    assert named(spark, todo, lying) == served_one_by_one(todo, lying)


def test_a_long_run_of_taken_numbers_is_passed_in_one_step(spark):
    lying = ["_a.jpg", *(f"_a_{k}.jpg" for k in range(1, 3000))]
    assert named(spark, [(1, "/a.jpg"), (2, "_a.jpg")], lying) == {1: "_a_3000.jpg", 2: "_a_3001.jpg"}
    assert named(spark, [], lying) == {}


def test_execution_never_gives_one_path_twice(spark):
    files = spark.createDataFrame([(1, 1, "/d/a.jpg", 5, None, "active"), (2, 1, "/d_a.jpg", 5, None, "active"), (3, 1, "/d/a_1.jpg", 5, None, "active")], "id long, session_id long, path string, size long, pixel_hash string, status string")
    acts = files.select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("file_id"), F.lit("delete").alias("action"), F.lit("file").alias("scope"), F.lit(None).cast("string").alias("executed_at"))
    bin_ = spark.createDataFrame([], "session_id long, file_id long, original_path string, trash_path string, deleted_at string, expires_at string, recovered_at string")
    gone = plan.execute(acts, files, bin_, 1, F.to_timestamp(F.lit("2024-06-01T00:00:00Z")), "/t")[2].collect()
    assert {r.file_id: r.trash_path for r in gone} == {1: "/t/1/_d_a.jpg", 3: "/t/1/_d_a_1.jpg", 2: "/t/1/_d_a_2.jpg"}


def test_ids_are_unique_and_dense_over_many_partitions(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        files = spark.createDataFrame([(7, 1, "/p/5.jpg", 3)], "id long, session_id long, path string, size long")
        found = spark.range(200_000).select((F.col("id") % 2).alias("session_id"), F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"), F.col("id").alias("size"))
        whole = sources.ingest(files, found.unionByName(found))
        whole.write.parquet(str(tmp_path / "files"))
        got = spark.read.parquet(str(tmp_path / "files"))
        ends = got.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        assert tuple(ends) == (200_000, 200_000, 7, 7 + 199_999)  # one of the found is known
        assert whole.join(got, ["session_id", "path", "id"], "left_anti").isEmpty()  # evaluated again, the ids are the same
        assert sources.ids_of(got, found).count() == 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ingest_of_nothing_and_of_repeated_rows(spark):
    schema = "id long, session_id long, path string, size long"
    none = spark.createDataFrame([], schema)
    assert sources.ingest(none, none.drop("id")).count() == 0
    found = spark.createDataFrame([(1, "/b", 9), (1, "/b", 2), (1, "/a", None)], "session_id long, path string, size long")
    assert sorted(map(tuple, sources.ingest(none, found).collect())) == [(1, 1, "/a", None), (2, 1, "/b", 2)]
