"""Queries over readings, sessions, record joins and ingest counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.expr import half_even
from seriesloom.functions.lanes import attach_row
from seriesloom.functions.quantile import quantiles
from seriesloom.operators import sessions as S
from seriesloom.operators.frames import digest
from seriesloom.plans.registry import query
from seriesloom.plans.roles import (ADMIT, SQL_READINGS, SQL_RECORDS, SQL_RUNS, SQL_SESSIONS, admitted, event_bound, r, readings,
                                    records, runs, sessions, sql, sr, static, table, us)

DAY = "CAST(day AS VARCHAR) AS day"


@query("admission_counts", sql(SQL_READINGS, """
SELECT count(*) AS raw_rows, CAST(count(*) FILTER (WHERE ts IS NULL) AS BIGINT) AS undated,
  CAST(count(*) FILTER (WHERE NOT (sbp BETWEEN 1 AND 400 AND dbp BETWEEN 5 AND 95 AND sbp - dbp >= -60)) AS BIGINT)
    AS rejected,
  CAST(count(*) FILTER (WHERE sbp BETWEEN 1 AND 400 AND dbp BETWEEN 5 AND 95 AND sbp - dbp >= -60) AS BIGINT)
    AS admissible FROM rd"""))
def admission_counts(spark, sf) -> DataFrame:
    keep = S.admissible(**ADMIT)
    return readings(spark, sf).agg(
        F.count("*").alias("raw_rows"), F.count_if(F.col("ts").isNull()).alias("undated"),
        F.count_if(~keep).alias("rejected"), F.count_if(keep).alias("admissible"))


@query("parse_timestamps", """
SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE d IS NULL) AS BIGINT) AS undated,
  CAST(max(d) AS VARCHAR) AS last_day
FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS d FROM events) GROUP BY 1""")
def parse_timestamps(spark, sf) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    d = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return (table(spark, sf, "events").select("event_type", d.alias("d")).groupBy("event_type")
            .agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("undated"),
                 F.max("d").cast("string").alias("last_day")))


@query("runs", sql(SQL_RUNS, f"""
SELECT patient_id, run, epoch_us(session_start) AS start_us, epoch_us(session_end) AS end_us, {sr('sbp')} AS sbp, dbp,
  {sr('sbp_post')} AS sbp_post, {sr('sbp_min')} AS sbp_min, uf_total, n_meas, {sr('session_hours')} AS session_hours,
  {DAY}, CAST(crosses_midnight AS INTEGER) AS crosses_midnight FROM runs"""))
def runs_query(spark, sf) -> DataFrame:
    return runs(spark, sf).select(
        "patient_id", "run", us("session_start").alias("start_us"), us("session_end").alias("end_us"),
        r("sbp").alias("sbp"), "dbp", r("sbp_post").alias("sbp_post"), r("sbp_min").alias("sbp_min"), "uf_total",
        "n_meas", r("session_hours").alias("session_hours"), F.col("day").cast("string").alias("day"),
        F.col("crosses_midnight").cast("int").alias("crosses_midnight"))


@query("sessions", sql(SQL_SESSIONS, f"""
SELECT patient_id, CAST(ts AS VARCHAR) AS day, {sr('sbp')} AS sbp, dbp, {sr('sbp_post')} AS sbp_post,
  {sr('sbp_min')} AS sbp_min, {sr('sbp_drop')} AS sbp_drop, uf_total, n_meas, {sr('session_hours')} AS session_hours,
  n_runs, {sr('weight')} AS weight, {sr('idwg')} AS idwg, session_source FROM sess"""))
def sessions_query(spark, sf) -> DataFrame:
    return sessions(spark, sf).select(
        "patient_id", F.col("ts").cast("string").alias("day"), r("sbp").alias("sbp"), "dbp",
        r("sbp_post").alias("sbp_post"), r("sbp_min").alias("sbp_min"), r("sbp_drop").alias("sbp_drop"), "uf_total",
        "n_meas", r("session_hours").alias("session_hours"), "n_runs", r("weight").alias("weight"),
        r("idwg").alias("idwg"), "session_source")


@query("first_records", sql(SQL_READINGS + "," + SQL_RECORDS, f"""
SELECT patient_id, {DAY}, {sr('weightstart')} AS weightstart, {sr('dryweight')} AS dryweight FROM rec"""))
def first_records(spark, sf) -> DataFrame:
    return records(spark, sf).select("patient_id", F.col("day").cast("string").alias("day"),
                                     r("weightstart").alias("weightstart"), r("dryweight").alias("dryweight"))


@query("static_join", sql(SQL_SESSIONS + """,
stat AS (SELECT c_custkey AS pid, c_mktsegment AS gender, CAST(2024 - (1930 + c_nationkey * 3) AS DOUBLE) AS age,
  CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END END AS DM,
  CASE WHEN c_custkey % 14 BETWEEN 10 AND 12 THEN concat('2010-', c_custkey % 14) END AS fd FROM customer)""", """
SELECT gender, age, DM, count(*) AS n_sessions, count(DISTINCT patient_id) AS n_patients,
  CAST(count(fd) AS BIGINT) AS n_first, max(fd) AS last_first
FROM sess LEFT JOIN stat ON patient_id = pid GROUP BY 1, 2, 3"""))
def static_join(spark, sf) -> DataFrame:
    joined = S.attach_static(sessions(spark, sf), static(spark, sf), bound=event_bound(spark, sf))
    return joined.groupBy("gender", "age", "DM").agg(
        F.count("*").alias("n_sessions"), F.count_distinct("patient_id").alias("n_patients"),
        F.count("first_dialysis_ts").alias("n_first"),
        F.date_format(F.max("first_dialysis_ts"), "yyyy-MM").alias("last_first"))


@query("key_sets", sql(SQL_SESSIONS + """,
sk AS (SELECT DISTINCT patient_id, day FROM days), rk AS (SELECT DISTINCT patient_id, day FROM rec),
ss AS (SELECT patient_id, min(day) AS lo, max(day) AS hi FROM sk GROUP BY 1),
rs AS (SELECT patient_id, min(day) AS lo, max(day) AS hi FROM rk GROUP BY 1),
p AS (SELECT coalesce(sk.patient_id, rk.patient_id) AS patient_id, coalesce(sk.day, rk.day) AS day,
  sk.day IS NOT NULL AS in_s, rk.day IS NOT NULL AS in_r
  FROM sk FULL JOIN rk ON sk.patient_id = rk.patient_id AND sk.day = rk.day)""", """
SELECT p.patient_id, CAST(p.day AS VARCHAR) AS day, CAST(in_s AS INTEGER) AS in_sessions,
  CAST(in_r AS INTEGER) AS in_records,
  CASE WHEN NOT in_r THEN CAST(coalesce(p.day BETWEEN rs.lo AND rs.hi, false) AS INTEGER) END AS inside_record_span,
  CASE WHEN NOT in_s THEN CAST(coalesce(p.day BETWEEN ss.lo AND ss.hi, false) AS INTEGER) END AS inside_session_span
FROM p LEFT JOIN ss ON p.patient_id = ss.patient_id LEFT JOIN rs ON p.patient_id = rs.patient_id"""))
def key_sets(spark, sf) -> DataFrame:
    p = S.key_sets(S.collapse_days(runs(spark, sf)), records(spark, sf), bound=event_bound(spark, sf))
    flags = ["in_sessions", "in_records", "inside_record_span", "inside_session_span"]
    return p.select("patient_id", F.col("day").cast("string").alias("day"),
                    *[F.col(c).cast("int").alias(c) for c in flags])


def ingest_counters(spark, sf) -> DataFrame:
    """One row of ingest counters; each part is one aggregate over its own table."""
    rn = runs(spark, sf)
    of_runs = rn.agg(F.count("*").alias("reading_runs"), F.count_if("crosses_midnight").alias("crossings"))
    days = S.collapse_days(rn)
    of_days = days.agg(F.count("*").alias("derived"), F.count_if(F.col("sbp") >= 200).alias("censored"))
    med = quantiles(days, [], "session_hours", {"median_hours": 0.5}, bound=table(spark, sf, "events").count())
    adm = admitted(spark, sf)
    calendar = (adm.select("patient_id", F.to_date("ts").alias("d")).distinct()
                .agg(F.count("*").alias("calendar_sessions")))
    rec = records(spark, sf, dedup=False)
    of_rec = rec.agg(F.count("*").alias("record_rows"), F.count_if(F.col("day").isNull()).alias("undated"))
    uniq = rec.select("patient_id", "day").distinct().agg(F.count("*").alias("published"))
    one = of_runs
    for part in (of_days, med, calendar, of_rec, uniq):
        one = attach_row(one, part)
    return one.select("*", (F.col("reading_runs") - F.col("derived")).alias("second_runs"),
                      (F.col("record_rows") - F.col("published")).alias("duplicate_records"))


SQL_COUNTERS = SQL_SESSIONS + """,
c AS (SELECT (SELECT count(*) FROM runs) AS reading_runs,
  (SELECT count(*) FROM runs WHERE crosses_midnight) AS crossings, (SELECT count(*) FROM days) AS derived,
  (SELECT count(*) FROM days WHERE sbp >= 200) AS censored,
  (SELECT quantile_cont(session_hours, 0.5) FROM days) AS median_hours,
  (SELECT count(*) FROM (SELECT DISTINCT patient_id, CAST(ts AS DATE) FROM adm)) AS calendar_sessions,
  (SELECT count(*) FROM rec0) AS record_rows, (SELECT count(*) FROM rec) AS published),
cc AS (SELECT *, reading_runs - derived AS second_runs, record_rows - published AS duplicate_records FROM c)"""


@query("ingest_counters", sql(SQL_COUNTERS, f"""
SELECT reading_runs, crossings, derived, censored, {sr('median_hours')} AS median_hours, calendar_sessions, record_rows,
  published, second_runs, duplicate_records FROM cc"""))
def ingest_counters_query(spark, sf) -> DataFrame:
    return ingest_counters(spark, sf).select(
        "reading_runs", "crossings", "derived", "censored", r("median_hours").alias("median_hours"),
        "calendar_sessions", "record_rows", "published", "second_runs", "duplicate_records")


@query("session_decomposition", sql(SQL_COUNTERS + """,
sk AS (SELECT DISTINCT patient_id, day FROM days), rk AS (SELECT DISTINCT patient_id, day FROM rec),
ss AS (SELECT patient_id, min(day) AS lo, max(day) AS hi FROM sk GROUP BY 1),
rs AS (SELECT patient_id, min(day) AS lo, max(day) AS hi FROM rk GROUP BY 1),
lo AS (SELECT count(*) AS n, count(*) FILTER (WHERE sk.day BETWEEN rs.lo AND rs.hi) AS inside FROM sk
  ANTI JOIN rk ON sk.patient_id = rk.patient_id AND sk.day = rk.day LEFT JOIN rs ON sk.patient_id = rs.patient_id),
ro AS (SELECT count(*) AS n, count(*) FILTER (WHERE rk.day BETWEEN ss.lo AND ss.hi) AS inside FROM rk
  ANTI JOIN sk ON sk.patient_id = rk.patient_id AND sk.day = rk.day LEFT JOIN ss ON rk.patient_id = ss.patient_id),
m AS (SELECT count(*) AS n FROM sk SEMI JOIN rk ON sk.patient_id = rk.patient_id AND sk.day = rk.day),
a AS (SELECT cc.*, lo.n AS lon, lo.inside AS loin, ro.n AS ron, ro.inside AS roin, m.n AS matched,
  derived - published AS delta, CAST(greatest(derived - published, 1) AS DOUBLE) AS base FROM cc, lo, ro, m)""", """
SELECT 0 AS line, 'published sessions' AS component, published AS n, CAST(NULL AS DOUBLE) AS share_of_delta FROM a
UNION ALL SELECT 1, 'derived sessions', derived, NULL FROM a
UNION ALL SELECT 2, 'delta', delta, 1.0 FROM a
UNION ALL SELECT 3, 'matched a record', matched, NULL FROM a
UNION ALL SELECT 4, 'no record, inside the record span', loin, round_even(loin / base, 4) FROM a
UNION ALL SELECT 5, 'no record, outside the record span', lon - loin, round_even((lon - loin) / base, 4) FROM a
UNION ALL SELECT 6, 'second run on the same day', second_runs, NULL FROM a
UNION ALL SELECT 7, 'duplicate records', duplicate_records, NULL FROM a
UNION ALL SELECT 8, 'record without reading, inside the session span', roin, NULL FROM a
UNION ALL SELECT 9, 'record without reading, outside the session span', ron - roin, NULL FROM a
UNION ALL SELECT 10, 'undated records', 0, NULL FROM a
UNION ALL SELECT 11, 'sessions crossing midnight', crossings, NULL FROM a
UNION ALL SELECT 12, 'sessions under calendar keying', calendar_sessions, NULL FROM a"""))
def session_decomposition(spark, sf) -> DataFrame:
    pairs = S.key_sets(S.collapse_days(runs(spark, sf)), records(spark, sf), bound=event_bound(spark, sf))
    return S.decompose(pairs, ingest_counters(spark, sf))


@query("reconciliation", sql(SQL_COUNTERS, """
SELECT 'readings' AS quantity, CAST(4000 AS DOUBLE) AS published, CAST(reading_runs AS DOUBLE) AS derived,
  round_even(reading_runs / CAST(4000 AS DOUBLE), 3) AS ratio FROM cc
UNION ALL SELECT 'sessions', published, derived, round_even(derived / CAST(published AS DOUBLE), 3) FROM cc
UNION ALL SELECT 'second runs', NULL, second_runs, NULL FROM cc
UNION ALL SELECT 'censored tail', NULL, round_even(censored / CAST(derived AS DOUBLE), 5), NULL FROM cc"""))
def reconciliation(spark, sf) -> DataFrame:
    c = ingest_counters(spark, sf).withColumn("censored_share", half_even(F.col("censored") / F.col("derived"), 5))
    known = S.reconcile(c, [("readings", 4000.0, "reading_runs"), ("second runs", None, "second_runs"),
                            ("censored tail", None, "censored_share")])
    own = c.select(F.lit("sessions").alias("quantity"), F.col("published").cast("double").alias("published"),
                   F.col("derived").cast("double").alias("derived"),
                   half_even(F.col("derived") / F.col("published"), 3).alias("ratio"))
    return known.unionByName(own)


@query("duplicate_keys", sql(SQL_READINGS + "," + SQL_RECORDS, """
SELECT count(*) AS keys_repeated, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows
FROM (SELECT patient_id, day, count(*) AS n FROM rec0 GROUP BY 1, 2) WHERE n > 1"""))
def duplicate_keys(spark, sf) -> DataFrame:
    n = records(spark, sf, dedup=False).groupBy("patient_id", "day").count().where("count > 1")
    return n.agg(F.count("*").alias("keys_repeated"),
                 F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_rows"))


@query("set_operations", sql(SQL_SESSIONS, """
SELECT 'both' AS side, count(*) AS n FROM (SELECT patient_id, day FROM days INTERSECT SELECT patient_id, day FROM rec)
UNION ALL SELECT 'sessions only', count(*) FROM (SELECT patient_id, day FROM days EXCEPT SELECT patient_id, day FROM rec)
UNION ALL SELECT 'records only', count(*) FROM (SELECT patient_id, day FROM rec EXCEPT SELECT patient_id, day FROM days)
UNION ALL SELECT 'stacked', count(*) FROM (SELECT patient_id, day FROM rec UNION ALL SELECT patient_id, day FROM days)"""))
def set_operations(spark, sf) -> DataFrame:
    d = S.collapse_days(runs(spark, sf)).select("patient_id", "day")
    k = records(spark, sf).select("patient_id", "day")
    parts = {"both": d.intersect(k), "sessions only": d.subtract(k), "records only": k.subtract(d),
             "stacked": k.unionByName(d)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("frame_digest")
def frame_digest(spark, sf) -> DataFrame:
    return digest(table(spark, sf, "events"))


@query("numbered_lineitem_runs", """
SELECT l_suppkey, run, count(*) AS n, CAST(min(l_shipdate) AS DATE)::VARCHAR AS first_day,
  CAST(max(l_shipdate) AS DATE)::VARCHAR AS last_day
FROM (SELECT l_suppkey, l_shipdate, CAST(sum(nw) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
      FROM (SELECT l_suppkey, l_shipdate, CASE WHEN lag(l_shipdate) OVER w IS NULL
              OR l_shipdate - lag(l_shipdate) OVER w > INTERVAL 30 DAY THEN 1 ELSE 0 END AS nw FROM lineitem
            WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate)))
GROUP BY 1, 2""")
def numbered_lineitem_runs(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey")
    out = S.number_runs(li, "l_suppkey", "l_shipdate", "l_orderkey", gap_hours=30 * 24.0)
    return out.groupBy("l_suppkey", "run").agg(
        F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).cast("string").alias("first_day"),
        F.to_date(F.max("l_shipdate")).cast("string").alias("last_day"))
