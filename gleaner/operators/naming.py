"""Free names in the bin for files that go there together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.storage import written


def numbered(flat: Column, number: Column) -> Column:
    """The name for a number: the name itself for 0, else with _number before its suffix."""
    suffix = F.regexp_extract(flat, r"(?s)(?<=.)(\.[^.]+)$", 1)
    stem = F.left(flat, F.length(flat) - F.length(suffix))
    return F.when(number == 0, flat).otherwise(F.concat(stem, F.lit("_"), number.cast("string"), suffix))


def _islands(names: DataFrame) -> DataFrame:
    """flat, lo, hi: runs of numbers that names (name) take of a flattened path."""
    of = F.regexp_replace("name", r"(?s)^(.*)_[1-9][0-9]{0,8}(\.[^.]+)?$", "$1$2")
    number = F.regexp_extract("name", r"(?s)^.*_([1-9][0-9]{0,8})(?:\.[^.]+)?$", 1)
    higher = names.filter(number != "").select("name", of.alias("flat"), number.cast("long").alias("number"))
    taken = names.select(F.col("name").alias("flat"), F.lit(0).cast("long").alias("number")).unionByName(higher.filter(numbered(F.col("flat"), F.col("number")) == F.col("name")).select("flat", "number"))
    run = F.col("number") - F.row_number().over(Window.partitionBy("flat").orderBy("number"))
    return taken.distinct().withColumn("run", run).groupBy("flat", "run").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).drop("run")


def free_names(todo: DataFrame, lying: DataFrame) -> DataFrame:
    """file_id, name: what each file of todo (file_id, path) is called in a bin that holds lying (name).

    The name is the flattened path, or the first number of it that is free,
    files being served in the order of their paths. All files propose at once:
    a name goes to the first of its proposers, and the others and those whose
    name lies in the bin propose their next number, until none has to. A file
    never gives a name up but to one that comes before it, so the result is
    that of serving them one by one. Files of one flattened path begin with
    numbers in their order, and runs of numbers that the bin holds are passed
    in one step, so rounds grow with chains of unlike paths only.
    """
    flat = F.coalesce(paths.trash_name(F.col("path")), F.lit(""))
    rank = F.row_number().over(Window.partitionBy("flat").orderBy("path", "file_id")) - 1
    now = written(todo.select("file_id", "path", flat.alias("flat")).withColumn("rank", rank).withColumn("number", F.col("rank").cast("long")), "names")
    names = written(lying.select("name").filter("name IS NOT NULL").distinct(), "taken-names")
    islands = written(_islands(names).join(now.select("flat").distinct(), "flat", "left_semi"), "taken-numbers")
    after = F.col("rank") + F.max(F.col("number") - F.col("rank")).over(Window.partitionBy("flat").orderBy("rank"))
    turn = 0
    while True:
        turn += 1
        spaced = now.withColumn("asked", after)
        jumped = spaced.join(islands, (spaced.flat == islands.flat) & F.col("asked").between(F.col("lo"), F.col("hi")), "left").select(spaced.file_id, spaced.path, spaced.flat, "rank", "number", F.coalesce(F.col("hi") + 1, "asked").alias("asked"))
        proposed = jumped.withColumn("name", numbered(F.col("flat"), F.col("asked")))
        place = F.row_number().over(Window.partitionBy("name").orderBy("path", "file_id"))
        judged = proposed.withColumn("place", place).join(names.withColumn("lies", F.lit(True)), "name", "left")
        lost = (F.col("place") > 1) | F.coalesce("lies", F.lit(False))
        step = written(judged.select("file_id", "path", "flat", "rank", F.col("number").alias("was"), (F.col("asked") + lost.cast("long")).alias("number"), "name"), f"names-{turn}")
        if step.filter("number <> was").isEmpty():
            return step.select("file_id", "name")
        now = step.drop("was", "name")
