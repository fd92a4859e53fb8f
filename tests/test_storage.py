"""Written tables and what they leave on disk."""

import time

from pyspark.sql import functions as F

from gleaner.storage import written


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before, key = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key, "false")
    frame = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    table = written(frame, "cleaned")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key, "false") == kept
    # What was run once can be run again.
    assert written(frame, "again").exceptAll(table).count() == 0 and frame.count() == 1000
