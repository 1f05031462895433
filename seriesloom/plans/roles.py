"""How the given tables play the roles of the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.config import Config
from seriesloom.functions.lanes import Lanes, lay_out
from seriesloom.functions.skew import attach
from seriesloom.operators import panel as P, sessions as S

CONFIG = Config(min_sessions=20, min_span_days=10)
ADMIT = dict(sbp_range=(1, 400), dbp_range=(5, 95), min_diff=-60)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


_KNOWN: dict[tuple, int] = {}


def longest(spark: SparkSession, sf: str, name: str, key: str) -> int:
    """Rows of the longest series of a base table: one narrow job, kept for the session."""
    at = (spark.sparkContext.applicationId, sf, name, key)
    if at not in _KNOWN:
        _KNOWN[at] = table(spark, sf, name).groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return _KNOWN[at]


def event_bound(spark, sf) -> int:
    return longest(spark, sf, "events", "user_id")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """events as readings: value as the first vital, props.k as the second, a flow that is often null."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("patient_id"), "ts", F.col("event_id").alias("seq"), "event_type",
        F.col("value").alias("sbp"), k.alias("dbp"), F.nullif(k % 7, F.lit(0)).cast("double").alias("uf"))


def admitted(spark, sf) -> DataFrame:
    return readings(spark, sf).where((F.col("event_type") != "signup") & S.admissible(**ADMIT))


def records(spark, sf, dedup=True) -> DataFrame:
    r = readings(spark, sf).where(F.col("event_type") == "signup").select(
        "patient_id", S.shifted_day("ts").alias("day"), "ts", "seq",
        (F.col("sbp") + 40).alias("weightstart"), (F.col("sbp") + 38).alias("weightend"),
        (F.col("dbp") + 20.0).alias("dryweight"), F.lit(36.5).alias("temperature"))
    return S.first_per_key(r, ["patient_id", "day"], ["ts", "seq"]) if dedup else r


def static(spark, sf) -> DataFrame:
    """customer as demographics: segment gives the sex letter, nation the birth year, balance the flag."""
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("gender"),
        (1930 + F.col("c_nationkey") * 3).alias("birthday"),
        F.when(F.col("c_acctbal") >= 0, (F.col("c_acctbal") > 5000).cast("int")).alias("DM"),
        F.concat(F.lit("2010-"), (F.col("c_custkey") % 14).cast("string")).alias("first_dialysis"))
    return S.with_age(c, 2024).select("patient_id", "gender", "age", "DM", "first_dialysis_ts")


def runs(spark, sf) -> DataFrame:
    return S.reduce_runs(S.number_runs(admitted(spark, sf), bound=event_bound(spark, sf)))


def sessions(spark, sf) -> DataFrame:
    s = S.collapse_days(runs(spark, sf))
    return (S.attach_records(s, records(spark, sf)).withColumnRenamed("day", "ts")
            .withColumn("series_id", F.col("patient_id")))


def panel(spark, sf, config: Config = CONFIG, reach: int = 31) -> Lanes:
    st = static(spark, sf).withColumnRenamed("patient_id", "series_id")
    return P.build_panel(sessions(spark, sf), st, config, bound=event_bound(spark, sf), reach=reach)


def event_lanes(spark, sf, reach: int = 31) -> Lanes:
    """Every event as a step of its user's series: the plain long panel used by detectors and metrics."""
    rows = readings(spark, sf).withColumnRenamed("patient_id", "series_id")
    return lay_out(rows, ["series_id"], ["ts", "seq"], reach=reach, bound=event_bound(spark, sf))


def r(c, digits: int = 6) -> Column:
    """Rounded for comparison.

    The tiny shift keeps exact decimal halves, which averages of cents often are, off the rounding edge;
    adding zero turns -0.0 into 0.0.
    """
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x.cast("double") + F.lit(float(f"1.234567e-{digits + 1}")), digits) + F.lit(0.0)


def us(c) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---- the same roles in SQL --------------------------------------------------------------------------

SQL_READINGS = """
rd AS (SELECT user_id AS patient_id, ts, event_id AS seq, event_type, value AS sbp,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS dbp,
        CAST(NULLIF(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7, 0) AS DOUBLE) AS uf FROM events),
adm AS (SELECT * FROM rd WHERE event_type <> 'signup' AND sbp BETWEEN 1 AND 400 AND dbp BETWEEN 5 AND 95
        AND sbp - dbp >= -60)"""

SQL_RUNS = SQL_READINGS + """,
gp AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY patient_id ORDER BY ts, seq)) AS gap FROM adm),
nr AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY patient_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM gp),
runs AS (SELECT patient_id, run, min(ts) AS session_start, max(ts) AS session_end,
        first(sbp ORDER BY ts, seq) AS sbp, first(dbp ORDER BY ts, seq) AS dbp,
        last(sbp ORDER BY ts, seq) AS sbp_post, min(sbp) AS sbp_min, max(uf) AS uf_total, count(*) AS n_meas,
        round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 / 3600.0, 2) AS session_hours,
        CAST(min(ts) - INTERVAL 8 HOUR AS DATE) AS day,
        CAST(max(ts) AS DATE) <> CAST(min(ts) AS DATE) AS crosses_midnight
        FROM nr GROUP BY patient_id, run)"""

SQL_RECORDS = """
rec0 AS (SELECT patient_id, CAST(ts - INTERVAL 8 HOUR AS DATE) AS day, ts, seq, sbp + 40 AS weightstart,
        sbp + 38 AS weightend, dbp + CAST(20 AS DOUBLE) AS dryweight, CAST(36.5 AS DOUBLE) AS temperature
        FROM rd WHERE event_type = 'signup'),
rec AS (SELECT * FROM rec0 QUALIFY row_number() OVER (PARTITION BY patient_id, day ORDER BY ts, seq) = 1)"""

SQL_STATIC = """
stat AS (SELECT c_custkey AS series_id, c_mktsegment AS gender,
        CAST(2024 - (1930 + c_nationkey * 3) AS DOUBLE) AS age,
        CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END END AS DM FROM customer)"""

SQL_SESSIONS = SQL_RUNS + "," + SQL_RECORDS + """,
days AS (SELECT patient_id, day, min(session_start) AS session_start, max(session_end) AS session_end,
        first(sbp ORDER BY session_start, run) AS sbp, first(dbp ORDER BY session_start, run) AS dbp,
        last(sbp_post ORDER BY session_start, run) AS sbp_post, min(sbp_min) AS sbp_min,
        CAST(sum(n_meas) AS BIGINT) AS n_meas, sum(session_hours) AS session_hours, count(*) AS n_runs,
        CASE WHEN count(*) > 1 THEN coalesce(sum(uf_total), 0) ELSE sum(uf_total) END AS uf_total
        FROM runs GROUP BY patient_id, day),
sess AS (SELECT d.*, d.sbp - d.sbp_min AS sbp_drop, d.patient_id AS series_id, d.day AS ts, weightstart, weightend,
        dryweight, temperature, weightstart AS weight, weightstart - dryweight AS idwg,
        CASE WHEN weightstart IS NOT NULL THEN 'd1' ELSE 'vip_only' END AS session_source
        FROM days d LEFT JOIN rec r ON d.patient_id = r.patient_id AND d.day = r.day)"""

SQL_PANEL = SQL_SESSIONS + "," + SQL_STATIC + """,
elig AS (SELECT series_id FROM sess GROUP BY series_id HAVING count(*) >= 20 AND max(ts) - min(ts) >= 10),
pn0 AS (SELECT s.*, t.gender, t.age, t.DM, row_number() OVER w - 1 AS step,
        CAST(s.ts - lag(s.ts) OVER w AS DOUBLE) AS days_since_last_raw
        FROM sess s JOIN elig e ON s.series_id = e.series_id LEFT JOIN stat t ON s.series_id = t.series_id
        WINDOW w AS (PARTITION BY s.series_id ORDER BY s.ts)),
pn AS (SELECT *, least(greatest(coalesce(days_since_last_raw, 2), 1), 30) AS days_since_last,
        sbp - dbp AS pulse_pressure, dbp + (sbp - dbp) / CAST(3 AS DOUBLE) AS map_est, isodow(ts) - 1 AS dow,
        CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN starts_with(upper(coalesce(gender, '')), 'M') THEN 1 ELSE 0 END AS is_male,
        coalesce(DM, 0) AS is_dm,
        CASE WHEN age IS NULL OR age < 0 OR age >= 200 THEN NULL WHEN age < 50 THEN '<50' WHEN age < 65 THEN '50-64'
             WHEN age < 75 THEN '65-74' ELSE '75+' END AS age_band,
        CASE WHEN step > round_even(max(step) OVER (PARTITION BY series_id)
                    * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE)), 0) THEN 'test'
             WHEN step > round_even(max(step) OVER (PARTITION BY series_id)
                    * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE) - CAST(0.2 AS DOUBLE)), 0) THEN 'val'
             ELSE 'train' END AS split,
        CASE WHEN CAST(concat('0x', substr(md5(concat('patient-split:', series_id)), 1, 8)) AS BIGINT) % 100 < 30
             THEN 'holdout' ELSE 'fit' END AS patient_split FROM pn0)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def sr(expr: str, digits: int = 6) -> str:
    """SQL counterpart of :func:`r`."""
    return f"round(CAST({expr} AS DOUBLE) + CAST(1.234567e-{digits + 1} AS DOUBLE), {digits}) + 0.0"


# ---- events as a long panel of their own ------------------------------------------------------------

EVENT_CONFIG = Config(min_sessions=20, min_span_days=10, search_warm=(16, 24, 32, 40), warm=32,
                      cuts=(12, 20, 28, 36, 44, 52), future=20)


def event_panel(spark: SparkSession, sf: str, reach: int = 31) -> Lanes:
    """One step per event: vitals scaled into a plausible range, clinical flags from the customer row and k."""
    c = table(spark, sf, "customer")
    nation, cust = F.col("c_nationkey"), F.col("c_custkey")
    flag = lambda x: F.when(x, 1).otherwise(0)
    who = c.select(
        cust.alias("series_id"), (94 - nation * 3).cast("double").alias("age"),
        flag(F.col("c_mktsegment").startswith("M")).alias("is_male"),
        flag(F.col("c_acctbal") > 5000).alias("is_dm"), flag(nation % 5 == 0).alias("has_afib"),
        flag(nation % 7 == 1).alias("has_cad"), flag(nation % 8 == 3).alias("has_hcm"),
        flag(nation % 6 < 2).alias("has_hf"), flag(nation % 11 == 4).alias("has_as"),
        F.when(nation % 6 == 0, "HFREF").when(nation % 6 == 1, "HFPEF").otherwise("NONE").alias("hf_type"),
        flag(~F.col("c_mktsegment").startswith("M") & (nation % 9 == 2)).alias("is_pregnant"),
        flag(cust % 4 == 0).alias("on_ace"), flag(cust % 3 == 0).alias("on_bb"), flag(cust % 5 == 2).alias("on_loop"),
        flag(cust % 7 == 3).alias("on_dhp_ccb"), F.col("c_mktsegment").alias("segment"))
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        F.col("user_id").alias("series_id"), "event_id", "ts", "event_type",
        (100 + F.col("value") * 0.5).alias("sbp"), (50 + k * 0.5).alias("dbp"), k.alias("k"),
        (1 + F.col("event_id") % 4).alias("n_meas"), (60 + F.col("value") * 0.1).alias("weight"),
        (40 + k).cast("double").alias("pulse"), (F.col("event_id") % 10 / 10.0).alias("adherence_7d"),
        (k % 4).alias("missed_3d"), F.when(k % 10 == 0, "STANDING").otherwise("SITTING").alias("position"),
        flag(k % 13 == 1).alias("dizziness"), flag(k % 37 == 5).alias("severe_headache"),
        flag(k % 29 == 3).alias("edema"), flag(k % 17 == 2).alias("palpitations"), flag(k % 19 == 4).alias("sob"),
        flag(k % 41 == 7).alias("syncope"), flag(k % 43 == 9).alias("face_swelling"),
        flag(k % 23 == 6).alias("dry_cough"))
    rows = attach(rows, who, "series_id", bound=event_bound(spark, sf))
    lanes = lay_out(rows, ["series_id"], ["ts", "event_id"], reach=reach, bound=event_bound(spark, sf))
    lanes.df = P.add_splits(lanes, P.attach_cadence(lanes, lanes.df), EVENT_CONFIG)
    return lanes


SQL_EVENT_PANEL = """
who AS (SELECT c_custkey AS series_id, CAST(94 - c_nationkey * 3 AS DOUBLE) AS age,
  CASE WHEN starts_with(c_mktsegment, 'M') THEN 1 ELSE 0 END AS is_male,
  CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS is_dm, CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END AS has_afib,
  CASE WHEN c_nationkey % 7 = 1 THEN 1 ELSE 0 END AS has_cad, CASE WHEN c_nationkey % 8 = 3 THEN 1 ELSE 0 END AS has_hcm,
  CASE WHEN c_nationkey % 6 < 2 THEN 1 ELSE 0 END AS has_hf, CASE WHEN c_nationkey % 11 = 4 THEN 1 ELSE 0 END AS has_as,
  CASE WHEN c_nationkey % 6 = 0 THEN 'HFREF' WHEN c_nationkey % 6 = 1 THEN 'HFPEF' ELSE 'NONE' END AS hf_type,
  CASE WHEN NOT starts_with(c_mktsegment, 'M') AND c_nationkey % 9 = 2 THEN 1 ELSE 0 END AS is_pregnant,
  CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS on_ace, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS on_bb,
  CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 0 END AS on_loop, CASE WHEN c_custkey % 7 = 3 THEN 1 ELSE 0 END AS on_dhp_ccb,
  c_mktsegment AS segment FROM customer),
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ep0 AS (SELECT e.user_id AS series_id, event_id, ts, event_type, 100 + value * CAST(0.5 AS DOUBLE) AS sbp,
  50 + k * CAST(0.5 AS DOUBLE) AS dbp, k, 1 + event_id % 4 AS n_meas, 60 + value * CAST(0.1 AS DOUBLE) AS weight,
  CAST(40 + k AS DOUBLE) AS pulse, event_id % 10 / CAST(10 AS DOUBLE) AS adherence_7d, k % 4 AS missed_3d,
  CASE WHEN k % 10 = 0 THEN 'STANDING' ELSE 'SITTING' END AS position,
  CASE WHEN k % 13 = 1 THEN 1 ELSE 0 END AS dizziness, CASE WHEN k % 37 = 5 THEN 1 ELSE 0 END AS severe_headache,
  CASE WHEN k % 29 = 3 THEN 1 ELSE 0 END AS edema, CASE WHEN k % 17 = 2 THEN 1 ELSE 0 END AS palpitations,
  CASE WHEN k % 19 = 4 THEN 1 ELSE 0 END AS sob, CASE WHEN k % 41 = 7 THEN 1 ELSE 0 END AS syncope,
  CASE WHEN k % 43 = 9 THEN 1 ELSE 0 END AS face_swelling, CASE WHEN k % 23 = 6 THEN 1 ELSE 0 END AS dry_cough,
  w.* EXCLUDE (series_id), row_number() OVER pw - 1 AS step,
  CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER pw)) / 86400000000.0) AS DOUBLE) AS days_since_last_raw
  FROM ev e LEFT JOIN who w ON e.user_id = w.series_id
  WINDOW pw AS (PARTITION BY e.user_id ORDER BY ts, event_id)),
ep AS (SELECT *, least(greatest(coalesce(days_since_last_raw, 2), 1), 30) AS days_since_last,
  CASE WHEN step > round_even(max(step) OVER (PARTITION BY series_id)
              * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE)), 0) THEN 'test'
       WHEN step > round_even(max(step) OVER (PARTITION BY series_id)
              * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE) - CAST(0.2 AS DOUBLE)), 0) THEN 'val' ELSE 'train' END AS split,
  CASE WHEN CAST(concat('0x', substr(md5(concat('patient-split:', series_id)), 1, 8)) AS BIGINT) % 100 < 30
       THEN 'holdout' ELSE 'fit' END AS patient_split,
  concat(CASE WHEN coalesce(age, 65) < 50 THEN '<50' WHEN coalesce(age, 65) < 65 THEN '50-64'
    WHEN coalesce(age, 65) < 75 THEN '65-74' ELSE '75+' END, '|', CASE WHEN is_male = 1 THEN 'M' ELSE 'F' END)
    AS cohort_key FROM ep0)"""


def event_rows(spark, sf) -> int:
    """Rows of the event table; parquet footers answer this."""
    return table(spark, sf, "events").count()
