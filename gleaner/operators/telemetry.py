"""Time series of runs: deltas, stage bands, totals and grades. Each run is a window partition of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _line():
    return Window.partitionBy("run_id").orderBy("noted_at", "row_id")


def interval_deltas(rows: DataFrame, counters: list[str]) -> DataFrame:
    """Cumulative counters as what each row adds."""
    return rows.select("run_id", "row_id", *[(F.col(c) - F.coalesce(F.lag(c).over(_line()), F.lit(0))).alias(f"{c}_delta") for c in counters])


def derived(rows: DataFrame) -> DataFrame:
    """Per row: microseconds since the one before (a second for the first), files per 1000 s, utilisation and backlog."""
    before = F.lag("noted_at").over(_line())
    dt = F.when(before.isNull(), F.lit(1_000_000)).otherwise(F.unix_micros(F.col("noted_at").cast("timestamp")) - F.unix_micros(before.cast("timestamp")))
    files = F.col("files") - F.coalesce(F.lag("files").over(_line()), F.col("files"))
    stepped = rows.select("run_id", "row_id", dt.alias("dt_us"), files.alias("new_files"), "active", "workers", "waiting", "queued")
    rate = F.when(F.col("dt_us") > 0, F.floor(F.col("new_files") * 1_000_000_000 / F.col("dt_us"))).otherwise(F.lit(0))
    return stepped.select("run_id", "row_id", "dt_us", rate.cast("long").alias("files_per_1000s"), F.least(F.floor(F.col("active") * 100 / F.col("workers")), F.lit(100)).cast("long").alias("utilisation"), (F.col("waiting") + F.col("queued")).alias("backlog"))


def stage_bands(rows: DataFrame) -> DataFrame:
    """Runs of one stage: run_id, stage, from and to the next one's beginning; an empty stage parts bands and is none."""
    change = F.when(F.lag("stage").over(_line()) == F.col("stage"), 0).otherwise(1)
    numbered = rows.withColumn("change", change).withColumn("island", F.sum("change").over(_line().rowsBetween(Window.unboundedPreceding, 0)))
    bands = numbered.groupBy("run_id", "island", "stage").agg(F.min("noted_at").alias("begins"), F.max("noted_at").alias("last"), F.count("*").alias("rows"))
    ends = F.coalesce(F.lead("begins").over(Window.partitionBy("run_id").orderBy("island")), F.col("last"))
    return bands.select("run_id", "island", "stage", "begins", ends.alias("ends"), "rows").filter("stage <> ''")


def totals(rows: DataFrame) -> DataFrame:
    """Per run and stage: rows, and files at the end."""
    return rows.filter("stage <> ''").groupBy("run_id", "stage").agg(F.count("*").alias("rows"), F.max("files").alias("files"), F.sum("queued").alias("queued"))


def summary(rows: DataFrame) -> DataFrame:
    """Per run what its file ends with: elapsed time over all and by stage, waits, events, files; `stages` and `breakdown` are texts "stage:number" in order."""
    joined = lambda value: F.array_join(F.sort_array(F.collect_list(F.concat("stage", F.lit(":"), value.cast("string")))), ",")
    spent = stage_bands(rows).groupBy("run_id", "stage").agg(F.sum(F.unix_micros(F.col("ends").cast("timestamp")) - F.unix_micros(F.col("begins").cast("timestamp"))).alias("us"), F.sum("rows").alias("rows"))
    stages = spent.groupBy("run_id").agg(joined(F.col("us")).alias("stages"), joined(F.col("rows")).alias("breakdown"))  # a stage is one of a few names
    micros = F.unix_micros(F.col("noted_at").cast("timestamp"))
    whole = rows.groupBy("run_id").agg((F.max(micros) - F.min(micros)).alias("elapsed_us"), F.max("lock_us").alias("lock_us"), F.count("*").alias("events"), F.max("files").alias("files"))
    return whole.join(stages, "run_id", "left")


def speed(rows: DataFrame, stage: str = "hashing") -> DataFrame:
    """Per run: files per 1000 s over the time of a stage (of the whole run without one), the largest rate of events per 1000 s, and how smooth that is.

    Smooth: at most 200 events a second and a backlog of 100; else minor
    delays if either is at most 500; else likely freezes. Fixed values.
    """
    spent = stage_bands(rows).filter(F.col("stage") == stage).groupBy("run_id").agg(F.sum(F.unix_micros(F.col("ends").cast("timestamp")) - F.unix_micros(F.col("begins").cast("timestamp"))).alias("stage_us"))
    rated = derived(rows).select(F.col("run_id").alias("run2"), F.col("row_id").alias("r2"), "dt_us", "backlog")
    counted = rows.withColumn("new_events", F.col("events") - F.coalesce(F.lag("events").over(_line()), F.col("events")))
    stepped = counted.join(rated, (F.col("run_id") == F.col("run2")) & (F.col("row_id") == F.col("r2")))
    rate = F.when(F.col("dt_us") > 0, F.floor(F.col("new_events") * 1_000_000_000 / F.col("dt_us"))).otherwise(F.lit(0))
    micros = F.unix_micros(F.col("noted_at").cast("timestamp"))
    most = stepped.groupBy("run_id").agg(F.max(rate).cast("long").alias("most_rate"), F.max("backlog").alias("most_backlog"), F.max("files").alias("files"), (F.max(micros) - F.min(micros)).alias("run_us"))
    took = F.coalesce("stage_us", "run_us")
    smooth = F.when((F.col("most_rate") <= 200_000) & (F.col("most_backlog") <= 100), "smooth").when((F.col("most_rate") <= 500_000) | (F.col("most_backlog") <= 500), "minor delays").otherwise("likely freezes")
    joined = most.join(spent, "run_id", "left")
    return joined.select("run_id", F.when(took > 0, F.floor(F.col("files") * 1_000_000_000 / took)).otherwise(F.lit(0)).cast("long").alias("files_per_1000s"), "most_rate", "most_backlog", smooth.alias("smoothness"))


def card(rows: DataFrame, stage: str = "hashing") -> DataFrame:
    """Per run: mean utilisation over the rows of a stage with its grade, and the row of the largest backlog."""
    made = derived(rows).withColumnsRenamed({"row_id": "r2", "run_id": "run2"})
    joined = rows.join(made, (F.col("row_id") == F.col("r2")) & (F.col("run_id") == F.col("run2"))).drop("r2", "run2")
    hashing = F.when(F.col("stage") == stage, F.col("utilisation"))
    out = joined.groupBy("run_id").agg(F.floor(F.avg(hashing)).cast("long").alias("utilisation"), F.max("backlog").alias("most_backlog"), F.max(F.struct(F.col("backlog"), (-F.col("row_id")).alias("row"))).alias("at"))
    grade = F.when(F.col("utilisation") >= 70, "good").when(F.col("utilisation") >= 40, "fair").otherwise("poor")
    return out.select("run_id", "utilisation", grade.alias("grade"), "most_backlog", (-F.col("at.row")).alias("backlog_row"))
