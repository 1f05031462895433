"""Queries over submitted readings, reading logs, banners, gates and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from seriesloom.lineage import checkpoint_dir, pin
from seriesloom.operators import detectors as D
from seriesloom.operators import gates as G
from seriesloom.operators import rules as R
from seriesloom.operators import serving as V
from seriesloom.operators import thresholds as O
from seriesloom.operators.learners import fit_predict
from seriesloom.plans.detector_queries import detector_frame, fairness_battery, shipped_detector
from seriesloom.plans.forecast_queries import (SMALL, SYMPTOMS, cold_start_curve, fit_rows, forecast_pairs, head_parity, learning_frame,
                                               missingness_sweep, prediction_explanations)
from seriesloom.plans.registry import query
from seriesloom.plans.roles import (EVENT_CONFIG as CFG, SQL_EVENT_PANEL, SQL_READINGS, event_bound, event_panel, event_rows, r,
                                    readings, sql, sr, table, us)
from seriesloom.plans.rule_queries import advisories, base_sql, event_alerts, extended_rows, smoothed_forecast
from seriesloom.plans.threshold_queries import cut_frame
from seriesloom.sources import reading_log
from seriesloom.streaming.rules import STORE, stream_alerts
from seriesloom.streaming.sessions import stream_sessions


def requests(spark, sf) -> DataFrame:
    """Events as submitted readings: profile from the customer, vocabulary keys from k, some of them unknown."""
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df)
    k = F.col("k")
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(c, v) for v, c in pairs]))
    return rows.select(
        F.col("series_id").alias("patient_id"), "event_id", F.to_date("ts").alias("date"), F.round("sbp").cast("int").alias("sbp"),
        F.round("dbp").cast("int").alias("dbp"), "pulse", "weight", "n_meas", "position", "age", "is_male", "is_pregnant",
        F.when(k % 3 == 0, None).otherwise(k % 2 == 0).alias("took_all_meds"), "hf_type", "missed_3d", "adherence_7d",
        pick(("dizziness", k % 13 == 1), ("sob", k % 19 == 4), ("chest_pain_dyspnea", k % 23 == 0), ("hiccups", k % 31 == 0)).alias("symptoms"),
        pick(("has_cad", F.col("has_cad") == 1), ("has_afib", F.col("has_afib") == 1)).alias("conditions"),
        pick(("on_ace", F.col("on_ace") == 1), ("on_bb", F.col("on_bb") == 1), ("on_magic", k % 43 == 0)).alias("medications"))


SQL_REQUESTS = SQL_EVENT_PANEL + """,
rq AS (SELECT series_id, event_id, CAST(ts AS DATE) AS d, CAST(round(sbp) AS INTEGER) AS s, CAST(round(dbp) AS INTEGER) AS b, pulse, k, is_male, is_pregnant,
  has_cad, has_afib, on_ace, on_bb, hf_type, count(*) OVER (PARTITION BY series_id, CAST(ts AS DATE)) AS same FROM ep)"""


@query("request_errors", sql(SQL_REQUESTS, """
SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN same > 1 THEN 'duplicate_date' END, CASE WHEN s - b < 10 THEN 'pulse_pressure' END,
  CASE WHEN s NOT BETWEEN 60 AND 260 THEN 'sbp_out_of_range' END, CASE WHEN b NOT BETWEEN 30 AND 160 THEN 'dbp_out_of_range' END,
  CASE WHEN k % 31 = 0 THEN 'unknown_symptoms' END, CASE WHEN k % 43 = 0 THEN 'unknown_medications' END,
  CASE WHEN is_male = 1 AND is_pregnant = 1 THEN 'pregnant_and_male' END], lambda x: x IS NOT NULL)) AS code FROM rq) GROUP BY 1"""))
def request_errors(spark, sf) -> DataFrame:
    return (V.reading_errors(requests(spark, sf), bound=event_bound(spark, sf)).select(F.explode("errors").alias("code")).groupBy("code")
            .agg(F.count("*").alias("n")))


@query("valid_requests", sql(SQL_REQUESTS, """
SELECT hf_type, count(*) AS n, CAST(sum(CASE WHEN hf_type <> 'NONE' THEN 1 ELSE 0 END) AS BIGINT) AS with_heart_failure FROM rq
WHERE same = 1 AND s - b >= 10 AND s BETWEEN 60 AND 260 AND b BETWEEN 30 AND 160 AND k % 31 <> 0 AND k % 43 <> 0 GROUP BY 1"""))
def valid_requests(spark, sf) -> DataFrame:
    v = V.valid(V.reading_errors(requests(spark, sf), bound=event_bound(spark, sf)))
    return v.groupBy("hf_type").agg(F.count("*").alias("n"), F.sum(F.array_contains("conditions", "has_hf").cast("long")).alias("with_heart_failure"))


@query("mapped_history", sql(SQL_REQUESTS, """
SELECT series_id AS patient_id, event_id, has_cad AS has_ihd, has_afib, on_ace, on_bb, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS took_all_meds,
  CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 2 <> 0 AND greatest(on_ace, on_bb) = 1 THEN 1 ELSE 0 END END AS missed_antihypertensive,
  CASE WHEN k % 19 = 4 THEN 1 ELSE 0 END AS sym_shortness_of_breath, CASE WHEN k % 13 = 1 OR k % 19 = 4 OR k % 23 = 0 THEN 1 ELSE 0 END AS sym_any,
  CASE WHEN k % 13 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 19 = 4 THEN 1 ELSE 0 END + CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS sym_count,
  CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS sym_red_flag, CASE WHEN k % 19 = 4 THEN 1 ELSE 0 END AS sym_mech_volume, CAST(NULL AS DOUBLE) AS uf_total FROM rq"""))
def mapped_history(spark, sf) -> DataFrame:
    h = V.to_history(requests(spark, sf))
    return h.select("patient_id", "event_id", "has_ihd", "has_afib", "on_ace", "on_bb", "took_all_meds", "missed_antihypertensive",
                    "sym_shortness_of_breath", "sym_any", "sym_count", "sym_red_flag", "sym_mech_volume", "uf_total")


def log_lines(spark, sf) -> DataFrame:
    """Events written out as log lines, a few of them broken in different ways."""
    e = readings(spark, sf)
    k, n = F.col("dbp"), F.col("seq")
    day, s = F.date_format("ts", "yyyy-MM-dd"), F.round(F.col("sbp") + 100).cast("int").cast("string")
    sep = F.when(n % 3 == 0, ", ").when(n % 3 == 1, ";").otherwise("\t")
    line = F.concat(day, sep, s, sep, k.cast("string"), F.when(n % 4 == 0, F.concat(sep, F.lit("72"))).otherwise(""),
                    F.when(n % 5 == 0, F.concat(sep, F.lit("meds="), F.when(k % 2 == 0, "Y").otherwise("no"))).otherwise(""),
                    F.when(n % 7 == 0, F.concat(sep, F.lit("sym=dizziness+sob"))).otherwise(""))
    raw = (F.when(n % 11 == 0, "# note").when(n % 13 == 0, F.concat(day, sep, s)).when(n % 17 == 0, F.concat(line, sep, F.lit("mood=bad")))
           .when(n % 19 == 0, F.concat(F.lit("someday"), sep, s, sep, F.lit("80"))).otherwise(line))
    return e.select("seq", raw.alias("raw"))


@query("reading_log", sql(SQL_READINGS, """
SELECT seq, CAST(ts AS DATE)::VARCHAR AS date, CAST(round(sbp + 100) AS INTEGER) AS sbp, CAST(dbp AS INTEGER) AS dbp,
  CASE WHEN seq % 4 = 0 THEN CAST(72 AS DOUBLE) END AS pulse, CASE WHEN seq % 5 = 0 THEN CASE WHEN dbp % 2 = 0 THEN 1 ELSE 0 END END AS took_all_meds,
  CASE WHEN seq % 7 = 0 THEN 2 END AS n_symptoms FROM rd WHERE seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0"""))
def reading_log_query(spark, sf) -> DataFrame:
    p = reading_log.good(reading_log.parse(log_lines(spark, sf)))
    return p.select("seq", F.col("date").cast("string").alias("date"), "sbp", "dbp", "pulse", F.col("took_all_meds").cast("int").alias("took_all_meds"),
                    F.when(F.col("symptoms").isNotNull(), F.size("symptoms")).alias("n_symptoms"))


@query("reading_log_errors", sql(SQL_READINGS, """
SELECT CASE WHEN seq % 13 = 0 THEN 'expected date, sbp, dbp' WHEN seq % 17 = 0 THEN 'unknown field mood' ELSE 'unreadable date' END AS error, count(*) AS n
FROM rd WHERE seq % 11 <> 0 AND (seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0) GROUP BY 1"""))
def reading_log_errors(spark, sf) -> DataFrame:
    return reading_log.bad(reading_log.parse(log_lines(spark, sf))).groupBy("error").agg(F.count("*").alias("n"))


@query("confidence_tiers", sql(SQL_EVENT_PANEL + """,
s AS (SELECT series_id, count(*) FILTER (WHERE k < 60) AS n, max(ts) AS t FROM ep GROUP BY 1)""", """
SELECT series_id, n, greatest(date_diff('day', CAST(t AS DATE), DATE '2024-02-12'), 0) AS age_days, CASE WHEN n < 7 THEN 'cold_start'
  WHEN greatest(date_diff('day', CAST(t AS DATE), DATE '2024-02-12'), 0) > 14 THEN 'stale' WHEN n < 48 THEN 'bootstrapping' ELSE 'steady' END AS tier FROM s"""))
def confidence_tiers(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    s = lanes.done(lanes.df).groupBy("series_id").agg(F.count_if(F.col("k") < 60).alias("n"), F.max("ts").alias("t"))
    age = V.reading_age(F.lit("2024-02-12").cast("date"), "t")
    return s.select("series_id", "n", age.alias("age_days"), V.confidence_tier("n", CFG, age).alias("tier"))


@query("banners")
def banners(spark, sf) -> DataFrame:
    """The one headline per series: emergency, detector, forecast, rule, staleness, in that order."""
    lanes, df = extended_rows(spark, sf)
    eng = R.summary(R.evaluate_extended(lanes.done(df))).select("series_id", "is_emergency", "fired", F.col("n_rows").alias("n"))
    name = shipped_detector(spark, sf)
    f = pin(detector_frame(spark, sf).select("series_id", "step", "split", name))          # the cut and the flags scan it
    t = D.timeline(f, name, D.serving_cut(f, name, 5, event_rows(spark, sf)))
    det = t.groupBy("series_id").agg(F.max_by("flagged", "step").alias("flagged"))
    last, ahead = smoothed_forecast(spark, sf)
    fc = R.predicted_alerts(last, ahead).groupBy("series_id").agg(F.max("fired").alias("forecast_fired"))
    j = eng.join(det, "series_id", "left").join(fc, "series_id", "left").withColumn("confidence_tier", V.confidence_tier("n", CFG))
    return j.select("series_id", V.banner().alias("b")).select("series_id", "b.*")


def gate_evidence(spark, sf) -> dict[str, DataFrame | None]:
    lanes, pop = event_alerts(spark, sf)
    lanes2, per = event_alerts(spark, sf, threshold=True)
    n = event_rows(spark, sf)
    panel = event_panel(spark, sf)
    rows = panel.done(panel.df)
    thr = pin(O.thresholds(rows, CFG, bound=n).select("threshold", "offset"))                                  # two gates
    name, seen = shipped_detector(spark, sf), ["sbp_lag1", "sbp_mean7", "dbp_lag1", "dbp_mean7"]
    det = pin(detector_frame(spark, sf).select(*dict.fromkeys(["series_id", "step", "split", name, *seen])))      # cut, flags and abstention scan it
    flags = D.timeline(det, name, D.serving_cut(det, name, 5, n)).where("split = 'test'").select("flagged")
    ood = pin(D.abstention(det, seen, bound=4 * n).where("split = 'test'").select("abstains", "ood_cut"))       # two gates
    lf = learning_frame(spark, sf)
    scored = fit_predict(fit_rows(lf), lf.where("split = 'test'"), "ridge", SMALL, "y_sbp_h0")
    err = F.avg(F.abs(F.col("y_sbp_h0") - F.col("p")))
    by = scored.groupBy("patient_split").agg(err.alias("mae"))
    penalty = by.agg((F.max(F.when(F.col("patient_split") == "holdout", F.col("mae")))
                      - F.max(F.when(F.col("patient_split") == "fit", F.col("mae")))).alias("penalty"))
    cuts = pin(cut_frame(spark, sf))                           # the fit scans it, and the prediction
    blend = O.predict_bayes_blend(cuts, O.fit_bayes_blend(cuts.where("offset_split = 'train'"), n), "_m")
    learned = blend.where("offset_split = 'holdout'").select(O.cap(F.col("_m"), CFG).alias("p"))
    by_size = Window.orderBy("n_readings")                     # one row per probe
    curve = cold_start_curve(spark, sf).select((F.col("band_width") - F.lag("band_width").over(by_size)).alias("widening"))
    return {
        "thresholds": thr, "detector_flags": flags, "alerts": lanes.done(pop),
        "emergencies": G.emergency_evidence(lanes.done(pop), lanes2.done(per)), "fairness": fairness_battery(spark, sf),
        "explanations": prediction_explanations(spark, sf), "abstention": ood, "cold_penalty": penalty,
        "advisories": advisories(spark, sf), "missingness": missingness_sweep(spark, sf),
        "forecaster_features": spark.createDataFrame([(c,) for c in SMALL], "feature string"),
        "detector": spark.createDataFrame([(name,)], "detector string"),
        "pairs": forecast_pairs(spark, sf).where("split = 'test'").select("codes"),
        "learned_thresholds": learned, "cold_start": curve, "shipped": None, "label_fairness": head_parity(spark, sf),
        "label_source": spark.createDataFrame([(s, True) for s in SYMPTOMS], "label string, synthetic boolean")}


@query("promotion_gates")
def promotion_gates(spark, sf) -> DataFrame:
    return G.run_gates(spark, gate_evidence(spark, sf), CFG)


@query("floor_gates", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step"), f"""
SELECT 'rule-engine fire rate (reported, not gated)' AS gate, 'PASS' AS status, {sr('avg(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END)')} AS observed FROM al
UNION ALL SELECT 'personalisation preserves every emergency', 'PASS', 0.0
UNION ALL SELECT 'explanation is non-zero', 'WARN', NULL"""))
def floor_gates(spark, sf) -> DataFrame:
    """Three gates with evidence of their own: reported, blocking, and absent."""
    lanes, pop = event_alerts(spark, sf)
    lanes2, per = event_alerts(spark, sf, threshold=True)
    g = G.run_gates(spark, {"alerts": lanes.done(pop), "emergencies": G.emergency_evidence(lanes.done(pop), lanes2.done(per))}, CFG)
    picked = ["rule-engine fire rate (reported, not gated)", "personalisation preserves every emergency", "explanation is non-zero"]
    return g.where(F.col("gate").isin(*picked)).select("gate", "status", r("observed").alias("observed"))


# ---- streaming: extensions with the batch semantics -----------------------------------------------------

def run_stream(spark, out: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream over everything there is, into a folder of its own, and read the result."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    q = (out.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("patient_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type",
                    F.col("value").alias("sbp"), k.alias("dbp"), F.nullif(k % 7, F.lit(0)).cast("double").alias("uf"))


@query("streamed_sessions", sql(SQL_READINGS + """,
g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY patient_id ORDER BY ts, seq)) AS gap FROM rd),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT patient_id, run, min(ts) AS a, max(ts) AS b, first(sbp ORDER BY ts, seq) AS sbp, min(sbp) AS sbp_min, count(*) AS n_meas FROM n GROUP BY 1, 2)""", f"""
SELECT patient_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, {sr('sbp')} AS sbp, {sr('sbp_min')} AS sbp_min, n_meas FROM s
WHERE epoch_us(b) + 21600000000 <= 1000 * (SELECT epoch_ms(max(ts)) FROM rd) - 43200000000"""))
def streamed_sessions(spark, sf) -> DataFrame:
    """Sessions closed by the watermark; the newest twelve hours stay open."""
    s = run_stream(spark, stream_sessions(event_stream(spark, sf)))
    return s.select("patient_id", us("session_start").alias("start_us"), us("session_end").alias("end_us"), r("sbp").alias("sbp"),
                    r("sbp_min").alias("sbp_min"), "n_meas")


@query("streamed_alerts", sql(SQL_READINGS + """,
q0 AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY patient_id ORDER BY ts, seq)) AS gap FROM rd
  WHERE epoch_us(ts) <= 1000 * (SELECT epoch_ms(max(ts)) FROM rd) - 43200000000),
q1 AS (SELECT *, coalesce(gap > 3 * 86400000000, true) AS new,
  sum(CASE WHEN gap > 3 * 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS part FROM q0),
sx AS (SELECT patient_id || '/' || part AS series_id, seq, ts, 100 + sbp * CAST(0.5 AS DOUBLE) AS sbp, 50 + dbp * CAST(0.5 AS DOUBLE) AS dbp, 2 AS n_meas,
  70.0 AS age, row_number() OVER (PARTITION BY patient_id, part ORDER BY ts, seq) - 1 AS step,
  least(greatest(CASE WHEN new THEN 2 ELSE floor(gap / 86400000000.0) END, 1), 30) AS days_since_last FROM q1),""" + base_sql("sx", "step"), """
SELECT tier, rule_id, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps FROM al WHERE v IS NOT NULL GROUP BY 1, 2"""))
def streamed_alerts(spark, sf) -> DataFrame:
    """Verdicts on all rows that the watermark has passed; a user who is silent for over three days starts anew."""
    e = event_stream(spark, sf).select(
        F.col("patient_id").alias("series_id"), "ts", "seq", (100 + F.col("sbp") * 0.5).alias("sbp"), (50 + F.col("dbp") * 0.5).alias("dbp"),
        F.lit(2).cast("long").alias("n_meas"), F.lit(70.0).alias("age"))
    out = run_stream(spark, stream_alerts(e, idle_days=3))
    return out.where("fired").groupBy("tier", "rule_id").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))
