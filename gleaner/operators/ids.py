"""Numbers for rows and ids for new rows of a table: unique, dense, and the same however often the rows are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.storage import written


def numbered(rows: DataFrame, key: list[str], name: str = "number") -> DataFrame:
    """rows (distinct in key) with their number from 1 on in the order of key.

    The rows are dealt by range, sorted and written, so that a row's range and
    its place there are fixed values; a range's first id is the count of the
    rows in those before it. No task numbers all rows.
    """
    # The number is the partition in the upper bits, and the place in it below.
    dealt = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("dealt", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("dealt", 33).alias("part")
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per range
    place = F.col("dealt").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("part", part).join(F.broadcast(starts), "part").withColumn(name, F.col("before") + place + 1).drop("part", "dealt", "before")


def with_ids(rows: DataFrame, key: list[str], table: DataFrame) -> DataFrame:
    """rows (distinct in key) with id: from the largest id of table on, without gaps, in the order of key."""
    most = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    return numbered(rows, key, "id").crossJoin(F.broadcast(most)).withColumn("id", F.col("id") + F.col("most")).drop("most")  # one row
