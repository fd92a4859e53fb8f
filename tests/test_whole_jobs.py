"""Registered queries on small tables of their own, where a thinned job would give less."""

from gleaner.operators import duplicates
from gleaner.plans import registry
from gleaner.plans.domain import load


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_path_functions_keeps_large_files(spark, tmp_path):
    sizes = [(1, 999), (2, 2_500), (3, 1_000_000), (4, 3 * 1024**2), (5, 5 * 1024**3), (31, 7)]
    d = documents(spark, tmp_path, [(i, f"t{i}", "en", "src1", n) for i, n in sizes])
    got = {r.id: (r.size_text, r.bytes_text) for r in registry.QUERIES["path_functions"](spark, d).collect()}
    assert set(got) == {i for i, _ in sizes}
    assert got[3][0] == "1.0 MB" and got[4] == ("3.1 MB", "3.0 MB") and got[5] == ("5368.7 MB", "5.0 GB") and got[1] == ("999 B", "999.0 B")


def test_size_text_rounds_as_the_binary_number_does(spark):
    from pyspark.sql import functions as F

    from gleaner.functions import paths

    sizes = [*range(1050, 200_000, 100), *range(1_050_000, 40_000_000, 100_000), 10**12 + 50_000, 1_250_000, 1_750_000]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", paths.size_text(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: f"{n / 1e6:.1f} MB" if n >= 1_000_000 else f"{n / 1e3:.1f} KB" for n in sizes}
    ratio = spark.range(1).select(paths.ratio_text(F.lit(47_000_000), F.lit(3_200_000)), paths.ratio_text(F.lit(0), F.lit(1))).first()
    assert tuple(ratio) == ("Compressed 47.0 MB → 3.2 MB (93% reduction)", "")


def test_fully_duplicated_folders_sees_every_file(spark, tmp_path):
    # /en/src1: copies with ids 3 and 6 make it whole; /en/src2: the unique file with id 9 disqualifies it.
    rows = [(3, "a", "src1"), (6, "a", "src1"), (7, "b", "src2"), (8, "b", "src2"), (9, "only", "src2")]
    d = documents(spark, tmp_path, [(i, t, "en", s, 1) for i, t, s in rows])
    got = duplicates.fully_duplicated_folders(load(spark, d, "files"), 1).collect()
    assert [(r.folder, r["files"]) for r in got] == [("/en/src1", 2)]
    by_hash = registry.QUERIES["fully_duplicated_folders"](spark, d).collect()  # a folder for each hash: those of two texts are whole
    assert sorted(r["files"] for r in by_hash) == [2, 2]


def test_scan_summary_counts_similarity_groups(spark, sf_dir):
    groups = registry.QUERIES["similarity_group_list"](spark, sf_dir).count()
    assert groups > 0
    assert registry.QUERIES["scan_summary"](spark, sf_dir).first().similarity_groups == groups


def test_toggle_actions_makes_replaces_clears_and_keeps_decisions(spark, tmp_path):
    # Decided: 1 keep, 3 keep, 4 delete, 17 ignore (not active); 2 is not.
    d = documents(spark, tmp_path, [(i, f"t{i}", "en", "src1", 1) for i in (1, 2, 3, 4, 17)])
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 1, 1), (17, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.QUERIES["toggle_actions"](spark, d).collect()
    assert sorted((r.file_id, r.action) for r in got) == [(1, "delete"), (2, "ignore"), (17, "ignore")]
