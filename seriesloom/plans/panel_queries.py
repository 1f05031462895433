"""Queries over the panel: cohort, cadence, clinical columns, splits, folds, thinning, placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.expr import bucket, cohort_key, entity_split, half_even
from seriesloom.operators import panel as P
from seriesloom.plans.registry import query
from seriesloom.plans.roles import (CONFIG, SQL_PANEL, SQL_SESSIONS, event_bound, longest, panel, r, sessions, sql, sr,
                                    table)
from seriesloom.functions.lanes import attach_row, lay_out

TS = "CAST(ts AS VARCHAR) AS day"


def _day():
    return F.col("ts").cast("string").alias("day")


@query("cohort", sql(SQL_SESSIONS, """
SELECT series_id, count(*) AS n_sessions, CAST(max(ts) - min(ts) AS BIGINT) AS span_days FROM sess GROUP BY 1
HAVING count(*) >= 20 AND max(ts) - min(ts) >= 10"""))
def cohort(spark, sf) -> DataFrame:
    return P.eligible(sessions(spark, sf), min_sessions=20, min_span_days=10)


@query("largest_series", sql(SQL_SESSIONS, """
SELECT series_id, count(*) AS n_sessions FROM sess GROUP BY 1 HAVING count(*) >= 20 AND max(ts) - min(ts) >= 10
ORDER BY n_sessions DESC, CAST(series_id AS VARCHAR) LIMIT 25"""))
def largest_series(spark, sf) -> DataFrame:
    c = P.eligible(sessions(spark, sf), min_sessions=20, min_span_days=10)
    return P.largest(c, 25).select("series_id", "n_sessions")


@query("panel", sql(SQL_PANEL, f"""
SELECT series_id, step, {TS}, days_since_last_raw, days_since_last, {sr('pulse_pressure')} AS pulse_pressure,
  {sr('map_est')} AS map_est, dow, is_weekend, is_male, is_dm, age_band, split, patient_split FROM pn"""))
def panel_query(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return lanes.done(lanes.df).select(
        "series_id", "step", _day(), "days_since_last_raw", "days_since_last",
        r("pulse_pressure").alias("pulse_pressure"), r("map_est").alias("map_est"), "dow", "is_weekend", "is_male",
        "is_dm", "age_band", "split", "patient_split")


@query("order_cadence", f"""
SELECT o_custkey, o_orderkey, step, raw, least(greatest(coalesce(raw, 1), 1), 400) AS gap,
  CASE WHEN step > round_even(max(step) OVER (PARTITION BY o_custkey) * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE)), 0)
       THEN 'test' ELSE 'train' END AS part
FROM (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS step,
        CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS DOUBLE) AS raw FROM orders
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def order_cadence(spark, sf) -> DataFrame:
    """Gaps over orders with bounds of their own, and the two-way tail split."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lanes = lay_out(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], reach=1,
                    bound=longest(spark, sf, "orders", "o_custkey"))
    df = lanes.df.withColumn("raw", P.raw_gap(lanes, "o_orderdate"))
    df = P.tail_split(lanes, df.withColumn("gap", P.model_gap("raw", 1.0, 1.0, 400.0)))
    return lanes.done(df).select("o_custkey", "o_orderkey", "step", "raw", "gap", "part")


@query("fractional_gaps", f"""
SELECT user_id, event_id, {sr("(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0")}
  AS gap_days FROM events""")
def fractional_gaps(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    lanes = lay_out(e, ["user_id"], ["ts", "event_id"], reach=1, bound=event_bound(spark, sf))
    return lanes.done(lanes.df.select("*", r(P.raw_gap(lanes, "ts", True)).alias("gap_days"))).select(
        "user_id", "event_id", "gap_days")


@query("entity_buckets", """
SELECT c_custkey, CAST(concat('0x', substr(md5(concat('offset-split:', c_custkey)), 1, 8)) AS BIGINT) % 100 AS bucket,
  CASE WHEN CAST(concat('0x', substr(md5(concat('patient-split:', c_custkey)), 1, 8)) AS BIGINT) % 100 < 30
       THEN 'holdout' ELSE 'fit' END AS part FROM customer""")
def entity_buckets(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", bucket("c_custkey", "offset-split").alias("bucket"),
                                               entity_split("c_custkey", CONFIG.holdout_frac).alias("part"))


@query("cohort_keys", sql(SQL_PANEL, """
SELECT cohort, count(*) AS n, count(DISTINCT series_id) AS n_series FROM (SELECT series_id,
  concat(CASE WHEN coalesce(age, 65) < 50 THEN '<50' WHEN coalesce(age, 65) < 65 THEN '50-64'
    WHEN coalesce(age, 65) < 75 THEN '65-74' ELSE '75+' END, '|', CASE WHEN is_male = 1 THEN 'M' ELSE 'F' END) AS cohort
  FROM pn) GROUP BY 1"""))
def cohort_keys(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return (lanes.done(lanes.df).select("series_id", cohort_key("age", "is_male").alias("cohort")).groupBy("cohort")
            .agg(F.count("*").alias("n"), F.count_distinct("series_id").alias("n_series")))


@query("inner_split", sql(SQL_PANEL, """
SELECT series_id, step, CASE WHEN (step + 1) / CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) <= 0.75
  THEN 'fit' ELSE 'check' END AS inner_part FROM pn"""))
def inner_split(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return lanes.done(P.inner_split(lanes, lanes.df)).select("series_id", "step", F.col("inner").alias("inner_part"))


@query("forward_folds", sql(SQL_PANEL + """,
q AS (SELECT series_id, step, (step + 1) / CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS q FROM pn),
f AS (SELECT 0 AS fold, CAST(0.4 AS DOUBLE) AS a, CAST(0.4 AS DOUBLE) + (CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE)) / 3 AS b
  UNION ALL SELECT 1, CAST(0.4 AS DOUBLE) + (CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE)) / 3,
    CAST(0.4 AS DOUBLE) + 2 * ((CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE)) / 3)
  UNION ALL SELECT 2, CAST(0.4 AS DOUBLE) + 2 * ((CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE)) / 3), 1.0)""", """
SELECT fold, role, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps
FROM (SELECT fold, step, CASE WHEN q <= a THEN 'train' ELSE 'valid' END AS role FROM q, f WHERE q <= b) GROUP BY 1, 2"""))
def forward_folds(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    ranked = lanes.done(P.percent_rank(lanes, lanes.df)).select("series_id", "step", "q")
    return P.folds(ranked, 3).groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


@query("thinned_panel", sql(SQL_PANEL, """
SELECT f AS drop_frac, series_id, count(*) - CASE WHEN count(*) <= 3 THEN 0
    ELSE CAST(round_even(f * (count(*) - 2), 0) AS BIGINT) END AS n_kept, CAST(0 AS BIGINT) AS first_step,
  max(step) AS last_old_step
FROM pn, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS f) GROUP BY 1, 2"""))
def thinned_panel(spark, sf) -> DataFrame:
    """Which interior rows go is a seeded hash draw; how many stay, and that both ends stay, is exact."""
    out = P.thin(panel(spark, sf), CONFIG.thin_fracs, 42, ["ts"])
    return out.groupBy("drop_frac", "series_id").agg(
        F.count("*").alias("n_kept"), F.min("old_step").alias("first_step"), F.max("old_step").alias("last_old_step"))


@query("placeholder_rows", sql(SQL_PANEL, f"""
SELECT series_id, max(step) + 1 AS step, {sr('coalesce(nullif(quantile_cont(days_since_last_raw, 0.5), 0), 2)')} AS median_gap,
  CAST(max(ts) + CAST(floor(coalesce(nullif(quantile_cont(days_since_last_raw, 0.5), 0), 2)) AS INTEGER) AS VARCHAR) AS day,
  CAST(greatest(DATE '2024-01-29', max(ts) + 1) AS VARCHAR) AS day_as_of
FROM pn GROUP BY series_id"""))
def placeholder_rows(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    rows = lanes.done(lanes.df).select("series_id", "ts", "step", "days_since_last_raw")
    a = P.placeholders(rows)
    b = P.placeholders(rows, as_of="2024-01-29").select("series_id", F.col("ts").cast("string").alias("day_as_of"))
    return a.select("series_id", "step", r("median_gap").alias("median_gap"), _day()).join(b, "series_id")


@query("forecast_schedule", sql(SQL_PANEL + """,
b AS (SELECT series_id, max(step) AS step, max(ts) AS ts,
  coalesce(nullif(quantile_cont(days_since_last_raw, 0.5), 0), 2) AS gap FROM pn GROUP BY 1)""", f"""
SELECT series_id, CAST(h AS INTEGER) AS h, {sr('round_even(gap * (h + 1), 1)')} AS days_ahead, step + h + 1 AS target_step,
  CAST(ts + CAST(floor(round_even(gap * (h + 1), 1)) AS INTEGER) AS VARCHAR) AS target_day
FROM b, (SELECT unnest([0, 1, 2]) AS h)"""))
def forecast_schedule(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    gap = F.coalesce(F.nullif(F.percentile("days_since_last_raw", F.lit(0.5)), F.lit(0.0)), F.lit(2.0))
    base = lanes.done(lanes.df).groupBy("series_id").agg(F.max("step").alias("step"), F.max("ts").alias("ts"),
                                                         gap.alias("median_gap"))
    return P.schedule(base, 3).select("series_id", "h", r("days_ahead").alias("days_ahead"), "target_step",
                                      F.col("target_ts").cast("string").alias("target_day"))


@query("engine_columns", sql(SQL_PANEL, f"""
SELECT series_id, step, step + 5 AS engine_step,
  {sr('coalesce(weight - lag(weight) OVER w, 0)')} AS weight_delta_24h,
  CAST(coalesce(lag(dbp) OVER w > 100, false) AS INTEGER) AS hr_high_recent,
  CAST(coalesce(lag(sbp) OVER w >= 180, false) AS INTEGER) AS prev_emergency
FROM pn WINDOW w AS (PARTITION BY series_id ORDER BY ts)"""))
def engine_columns(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    out = lanes.done(P.engine_columns(lanes, lanes.df, 5, pulse="dbp"))
    return out.select("series_id", "step", "engine_step", r("weight_delta_24h").alias("weight_delta_24h"),
                      F.col("hr_high_recent").cast("int").alias("hr_high_recent"),
                      F.col("prev_emergency").cast("int").alias("prev_emergency"))


@query("slow_pulse_runs", """
SELECT user_id, event_id, CASE WHEN calm THEN count(*) OVER (PARTITION BY user_id, calm, brk ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) ELSE 0 END AS brady_run_len
FROM (SELECT *, sum(CASE WHEN calm THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) AS brk
      FROM (SELECT user_id, event_id, ts, value BETWEEN 20 AND 80 AND event_type <> 'error' AS calm FROM events))""")
def slow_pulse_runs(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", "event_type")
    lanes = lay_out(e, ["user_id"], ["ts", "event_id"], bound=event_bound(spark, sf))
    calm = F.col("value").between(20, 80) & (F.col("event_type") != "error")
    return lanes.done(P.run_length(lanes, lanes.df, "brady_run_len", calm)).select("user_id", "event_id", "brady_run_len")


@query("split_sizes", sql(SQL_PANEL, """
SELECT split, patient_split, count(*) AS n, count(DISTINCT series_id) AS n_series,
  round_even(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share FROM pn GROUP BY 1, 2"""))
def split_sizes(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    g = lanes.done(lanes.df).groupBy("split", "patient_split").agg(
        F.count("*").alias("n"), F.count_distinct("series_id").alias("n_series"))
    total = g.agg(F.sum("n").alias("_total"))
    return attach_row(g, total).withColumn("share", half_even(F.col("n") / F.col("_total"), 4)).drop("_total")
