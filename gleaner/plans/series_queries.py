"""Queries on telemetry series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import telemetry
from gleaner.plans.domain import load

REGISTERED: dict = {}


def query(sql: str | None):
    def register(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return register


_W = "(PARTITION BY run_id ORDER BY noted_at, row_id)"


@query(f"SELECT run_id, row_id, lock_us - coalesce(lag(lock_us) OVER {_W}, 0) AS lock_us_delta, files - coalesce(lag(files) OVER {_W}, 0) AS files_delta FROM {{telemetry}}")
def telemetry_deltas(spark, d):
    return telemetry.interval_deltas(load(spark, d, "telemetry"), ["lock_us", "files"])


_DERIVED = f"""
WITH s AS (SELECT *, coalesce(epoch_us(noted_at) - lag(epoch_us(noted_at)) OVER {_W}, 1000000) AS dt_us, files - coalesce(lag(files) OVER {_W}, files) AS new_files FROM {{telemetry}}),
derived AS (SELECT run_id, row_id, stage, dt_us, CASE WHEN dt_us > 0 THEN floor(new_files * 1000000000 / dt_us)::BIGINT ELSE 0 END AS files_per_1000s,
  least(floor(active * 100 / workers), 100)::BIGINT AS utilisation, waiting + queued AS backlog FROM s)"""


@query(_DERIVED + " SELECT run_id, row_id, dt_us, files_per_1000s, utilisation, backlog FROM derived")
def telemetry_derived(spark, d):
    return telemetry.derived(load(spark, d, "telemetry"))


@query(_DERIVED + """ SELECT run_id, floor(avg(utilisation) FILTER (stage = 'click'))::BIGINT AS utilisation,
  CASE WHEN floor(avg(utilisation) FILTER (stage = 'click')) >= 70 THEN 'good' WHEN floor(avg(utilisation) FILTER (stage = 'click')) >= 40 THEN 'fair' ELSE 'poor' END AS grade,
  max(backlog) AS most_backlog, arg_max(row_id, backlog * 1000000000 - row_id) AS backlog_row FROM derived GROUP BY run_id""")
def telemetry_card(spark, d):
    return telemetry.card(load(spark, d, "telemetry"), "click")


@query(f"""
WITH c AS (SELECT *, CASE WHEN lag(stage) OVER {_W} = stage THEN 0 ELSE 1 END AS change FROM {{telemetry}}),
i AS (SELECT *, sum(change) OVER (PARTITION BY run_id ORDER BY noted_at, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c),
b AS (SELECT run_id, island, stage, min(noted_at) AS begins, max(noted_at) AS last, count(*) AS rows FROM i GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(lead(begins) OVER (PARTITION BY run_id ORDER BY island), last) AS ends FROM b)
SELECT run_id, island, stage, epoch_us(begins) AS begins, epoch_us(ends) AS ends, rows FROM e WHERE stage <> ''""")
def telemetry_bands(spark, d):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return telemetry.stage_bands(load(spark, d, "telemetry")).select("run_id", "island", "stage", micros("begins"), micros("ends"), "rows")


@query("SELECT run_id, stage, count(*) AS rows, max(files) AS files, sum(queued)::BIGINT AS queued FROM {telemetry} WHERE stage <> '' GROUP BY 1, 2")
def telemetry_totals(spark, d):
    return telemetry.totals(load(spark, d, "telemetry"))


_BANDS = f"""
WITH c AS (SELECT *, CASE WHEN lag(stage) OVER {_W} = stage THEN 0 ELSE 1 END AS change FROM {{telemetry}}),
i AS (SELECT *, sum(change) OVER (PARTITION BY run_id ORDER BY noted_at, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c),
b AS (SELECT run_id, island, stage, min(noted_at) AS begins, max(noted_at) AS last, count(*) AS rows FROM i GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(lead(begins) OVER (PARTITION BY run_id ORDER BY island), last) AS ends FROM b),
spent AS (SELECT run_id, stage, sum(epoch_us(ends) - epoch_us(begins))::BIGINT AS us, sum(rows)::BIGINT AS rows FROM e WHERE stage <> '' GROUP BY 1, 2)"""


@query(_BANDS + """, stages AS (SELECT run_id, string_agg(concat(stage, ':', us::VARCHAR), ',' ORDER BY concat(stage, ':', us::VARCHAR)) AS stages, string_agg(concat(stage, ':', rows::VARCHAR), ',' ORDER BY concat(stage, ':', rows::VARCHAR)) AS breakdown FROM spent GROUP BY 1)
SELECT run_id, max(epoch_us(noted_at)) - min(epoch_us(noted_at)) AS elapsed_us, max(lock_us) AS lock_us, count(*) AS events, max(files) AS files, any_value(stages) AS stages, any_value(breakdown) AS breakdown FROM {telemetry} LEFT JOIN stages USING (run_id) GROUP BY 1""")
def telemetry_summary(spark, d):
    return telemetry.summary(load(spark, d, "telemetry"))


@query(_BANDS + f""", n AS (SELECT *, coalesce(epoch_us(noted_at) - lag(epoch_us(noted_at)) OVER {_W}, 1000000) AS dt, events - coalesce(lag(events) OVER {_W}, events) AS fresh FROM {{telemetry}}),
m AS (SELECT run_id, max(CASE WHEN dt > 0 THEN floor(fresh * 1000000000 / dt)::BIGINT ELSE 0 END) AS most_rate, max(waiting + queued) AS most_backlog, max(files) AS files, max(epoch_us(noted_at)) - min(epoch_us(noted_at)) AS run_us FROM n GROUP BY 1),
t AS (SELECT m.*, coalesce(s.us, run_us) AS took FROM m LEFT JOIN spent s ON s.run_id = m.run_id AND s.stage = 'click')
SELECT run_id, CASE WHEN took > 0 THEN floor(files * 1000000000 / took)::BIGINT ELSE 0 END AS files_per_1000s, most_rate, most_backlog,
CASE WHEN most_rate <= 200000 AND most_backlog <= 100 THEN 'smooth' WHEN most_rate <= 500000 OR most_backlog <= 500 THEN 'minor delays' ELSE 'likely freezes' END AS smoothness FROM t""")
def telemetry_speed(spark, d):
    return telemetry.speed(load(spark, d, "telemetry"), "click")
