"""Queries over the rule registry, alerts, advisories and dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.lanes import Lanes
from seriesloom.operators import features as W
from seriesloom.operators import panel as P
from seriesloom.operators import rules as R
from seriesloom.operators.frames import provenance
from seriesloom.operators.rulebook import CASCADE, RULE_TABLE, TIERS, lines
from seriesloom.plans.feature_queries import frame, sql_expand, sql_lag, sql_roll
from seriesloom.plans.registry import query
from seriesloom.plans.roles import (CONFIG, EVENT_CONFIG, SQL_EVENT_PANEL, SQL_PANEL, event_bound, event_panel, event_rows, panel,
                                    r, sql, sr, table)
from seriesloom.plans.threshold_queries import SQL_PRIOR
from seriesloom.operators import thresholds as O

EMERGENCY = "tier IN ('BP_LEVEL_2', 'BP_LEVEL_2_SYMPTOM_OVERRIDE', 'TIER_1_ANGIOEDEMA')"


def base_sql(source: str, order: str, threshold: str | None = None, idwg: bool = False, age: str = "NULL") -> str:
    """The base cascade as SQL over a panel; ``age`` is the reading age, null where unknown."""
    personal = f"WHEN sbp >= {threshold} THEN 'BP_LEVEL_1_HIGH|RULE_PERSONALIZED_HIGH|PERSONALIZED'" if threshold else ""
    fluid = "WHEN idwg >= 4 THEN 'BP_LEVEL_1_LOW|RULE_HF_DECOMPENSATION|STANDARD'" if idwg else ""
    return f"""
g0 AS (SELECT *, CASE WHEN coalesce({age}, days_since_last) > 14 THEN 'HISTORICAL_ENTRY'
    WHEN coalesce(n_meas, 99) < 2 THEN 'SINGLE_READING_NON_EMERGENCY' ELSE 'NONE' END AS gate FROM {source}),
g1 AS (SELECT *, (sbp >= 180 OR dbp >= 120) AND gate <> 'HISTORICAL_ENTRY' AS em FROM g0),
g2 AS (SELECT *, coalesce(lag(em) OVER (PARTITION BY series_id ORDER BY {order}), false) AS pe FROM g1),
g3 AS (SELECT *, CASE WHEN em THEN 'BP_LEVEL_2|RULE_ABSOLUTE_EMERGENCY|STANDARD' WHEN gate <> 'NONE' THEN NULL {personal}
    WHEN sbp >= 140 OR dbp >= 90 THEN 'BP_LEVEL_1_HIGH|RULE_STANDARD_L1_HIGH|STANDARD'
    WHEN age >= 65 AND sbp < 100 THEN 'BP_LEVEL_1_LOW|RULE_AGE_65_LOW|STANDARD'
    WHEN sbp < 90 OR dbp < 60 THEN 'BP_LEVEL_1_LOW|RULE_STANDARD_L1_LOW|STANDARD' {fluid}
    WHEN pe AND sbp < 140 THEN 'TIER_3_INFO|RULE_EMERGENCY_RANGE_CONFIRMED_NORMAL|STANDARD'
    WHEN sbp - dbp >= 60 THEN 'TIER_3_INFO|RULE_PULSE_PRESSURE_WIDE|STANDARD'
    WHEN sbp - dbp <= 25 THEN 'TIER_3_INFO|RULE_PULSE_PRESSURE_NARROW|STANDARD'
    WHEN step < 12 THEN 'TIER_3_INFO|RULE_FIRST_MONTH_ADHERENCE_NUDGE|STANDARD' END AS v FROM g2),
al AS (SELECT *, split_part(v, '|', 1) AS tier, split_part(v, '|', 2) AS rule_id FROM g3)"""


def event_alerts(spark, sf, threshold: bool = False, aged: bool = False):
    lanes = event_panel(spark, sf)
    df = lanes.df
    if aged:
        df = df.withColumn("reading_age_days", F.greatest(F.datediff(F.lit("2024-01-31"), F.to_date("ts")), F.lit(0)))
    if threshold:
        rows = event_panel(spark, sf)
        t = O.thresholds(rows.done(rows.df), EVENT_CONFIG, bound=event_rows(spark, sf))
        df = R.with_threshold(df, t, bound=lanes.longest)
    return lanes, R.evaluate_base(lanes, df, "ml_threshold" if threshold else None)


@query("alerts_per_tier", sql(SQL_PANEL + "," + base_sql("pn", "ts", idwg=True) + f""",
f AS (SELECT *, {sql_lag('sbp', 1)} AS l1, {sql_expand('avg', 'sbp')} AS m, {sql_expand('stddev_samp', 'sbp')} AS s,
  {sql_roll('avg', 'sbp', 7, 2)} AS m7, CASE WHEN count(sbp) OVER {frame(-7, -1)} = 7
  THEN regr_slope(sbp, step) OVER {frame(-7, -1)} END AS s7 FROM al)""", f"""
SELECT tier, rule_id, count(*) AS n, count(DISTINCT series_id) AS n_series, {sr('avg((l1 - m) / nullif(s, 0))')} AS mean_z,
  {sr('avg(m7)')} AS mean_level7, {sr('avg(s7)')} AS mean_slope7 FROM f WHERE v IS NOT NULL GROUP BY 1, 2"""))
def alerts_per_tier(spark, sf) -> DataFrame:
    """Readings -> sessions -> panel -> causal features -> rules -> alerts per tier, over one shuffle of the events."""
    lanes = panel(spark, sf)
    judged = R.evaluate_base(lanes, lanes.df)
    f = W.build_features(lanes, CONFIG, judged)
    return f.where("fired").groupBy("tier", "rule_id").agg(
        F.count("*").alias("n"), F.count_distinct("series_id").alias("n_series"), r(F.avg("sbp_z")).alias("mean_z"),
        r(F.avg("sbp_mean7")).alias("mean_level7"), r(F.avg("sbp_slope7")).alias("mean_slope7"))


ALERT_SQL = """
SELECT series_id, event_id, gate AS gate_reason, CASE WHEN v IS NULL THEN NULL ELSE tier END AS tier,
  CASE WHEN v IS NULL THEN NULL ELSE rule_id END AS rule_id,
  CASE WHEN v LIKE '%PERSONALIZED' THEN 'PERSONALIZED' ELSE 'STANDARD' END AS mode, CAST(em AS INTEGER) AS is_emergency FROM al"""


def alert_columns(df: DataFrame) -> DataFrame:
    return df.select("series_id", "event_id", "gate_reason", "tier", "rule_id", "mode",
                     F.col("is_emergency").cast("int").alias("is_emergency"))


@query("alerts_population", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step"), ALERT_SQL))
def alerts_population(spark, sf) -> DataFrame:
    lanes, a = event_alerts(spark, sf)
    return alert_columns(lanes.done(a))


@query("alerts_aged", sql(SQL_EVENT_PANEL + "," + base_sql(
    "ep", "step", age="greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31'), 0)"), ALERT_SQL))
def alerts_aged(spark, sf) -> DataFrame:
    lanes, a = event_alerts(spark, sf, aged=True)
    return alert_columns(lanes.done(a))


PERSONAL_SOURCE = SQL_PRIOR + """,
src AS (SELECT ep.*, thr.threshold AS ml_threshold FROM ep LEFT JOIN thr ON ep.series_id = thr.series_id)"""


@query("alerts_personalised", sql(PERSONAL_SOURCE + "," + base_sql("src", "step", "ml_threshold"), ALERT_SQL))
def alerts_personalised(spark, sf) -> DataFrame:
    lanes, a = event_alerts(spark, sf, threshold=True)
    return alert_columns(lanes.done(a))


@query("emergency_parity", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step"), """
SELECT CAST(count(*) FILTER (WHERE em) AS BIGINT) AS population, CAST(count(*) FILTER (WHERE em) AS BIGINT) AS personalised,
  CAST(0 AS BIGINT) AS lost FROM al"""))
def emergency_parity(spark, sf) -> DataFrame:
    keys = lambda la: la[0].done(la[1]).where("is_emergency").select("series_id", "step")
    a, b = keys(event_alerts(spark, sf)), keys(event_alerts(spark, sf, threshold=True))
    lost = a.join(b, ["series_id", "step"], "left_anti").agg(F.count("*").alias("lost"))
    from seriesloom.functions.lanes import attach_row
    return attach_row(attach_row(a.agg(F.count("*").alias("population")), b.agg(F.count("*").alias("personalised"))), lost)


def extended_rows(spark, sf) -> tuple[Lanes, DataFrame]:
    lanes = event_panel(spark, sf)
    return lanes, P.brady_run(lanes, P.engine_columns(lanes, lanes.df))


def extended_sql() -> str:
    """The extended cascade as one CASE, from the same table of fixed conditions."""
    rows = lines(CASCADE)
    of = lambda axis: [(r, t, c) for a, r, t, c in rows if a == axis]
    flags = ("is_pregnant has_hf has_afib has_cad has_hcm has_as on_ace on_bb on_loop on_dhp_ccb severe_headache edema "
             "dizziness syncope palpitations sob dry_cough face_swelling hr_high_recent prev_emergency").split()
    absent = ("has_dcm has_tachy has_brady on_arb on_ndhp_ccb on_thiazide on_mra on_nitrate on_antiarr on_nsaid "
              "visual_changes altered_mental chest_pain_dyspnea focal_neuro severe_epigastric new_onset_headache ruq_pain "
              "leg_swelling fatigue nsaid_use throat_tightness missed_bb_today").split()
    cols = ", ".join([f"CAST({f} AS INTEGER) <> 0 AS {f}" for f in flags] + [f"false AS {f}" for f in absent])
    when = lambda items: " ".join(f"WHEN {c} THEN '{t}|{r}'" for r, t, c in items)
    rest = of("CONTRAINDICATION") + of("TIER_2") + of("L1") + of("TIER_3")
    return f"""
x0 AS (SELECT *, coalesce(weight - lag(weight) OVER w, 0) AS weight_delta_24h,
  coalesce(lag(pulse) OVER w > 100, false) AS hr_high_recent, coalesce(lag(sbp) OVER w >= 180, false) AS prev_emergency,
  pulse BETWEEN 40 AND 49 AND dizziness = 0 AS calm,
  CASE WHEN days_since_last > 14 THEN 'HISTORICAL_ENTRY' WHEN n_meas < 2 THEN 'SINGLE_READING_NON_EMERGENCY' ELSE 'NONE' END AS gate
  FROM ep WINDOW w AS (PARTITION BY series_id ORDER BY step)),
x1 AS (SELECT *, sum(CASE WHEN calm THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS brk FROM x0),
x2 AS (SELECT *, CASE WHEN calm THEN count(*) OVER (PARTITION BY series_id, calm, brk ORDER BY step ROWS UNBOUNDED PRECEDING)
  ELSE 0 END AS brady_run_len FROM x1),
x3 AS (SELECT series_id, event_id, step, gate, sbp, dbp, pulse, age, n_meas, missed_3d, brady_run_len, weight_delta_24h,
  adherence_7d, hf_type, position, CAST(NULL AS DOUBLE) AS ml_threshold, CAST(NULL AS DOUBLE) AS provider_target, {cols} FROM x2),
x4 AS (SELECT *, CASE {when(of("EMERGENCY"))} END AS urgent FROM x3),
x5 AS (SELECT *, CASE WHEN urgent IS NOT NULL AND gate = 'HISTORICAL_ENTRY' THEN NULL WHEN urgent IS NOT NULL THEN urgent
  WHEN gate = 'SINGLE_READING_NON_EMERGENCY' AND (sbp >= 180 OR dbp >= 120) AND n_meas < 2
    THEN 'TIER_1_CONTRAINDICATION|RULE_UNCONFIRMED_EMERGENCY' WHEN gate <> 'NONE' THEN NULL
  ELSE CASE {when(rest)} END END AS v FROM x4),
xa AS (SELECT *, CASE WHEN v IS NOT NULL THEN split_part(v, '|', 1) END AS tier,
  CASE WHEN v IS NOT NULL THEN split_part(v, '|', 2) END AS rule_id FROM x5)"""


@query("alerts_extended", sql(SQL_EVENT_PANEL + "," + extended_sql(), """
SELECT series_id, event_id, tier, rule_id, brady_run_len, CASE WHEN urgent IS NULL AND v LIKE '%UNCONFIRMED_EMERGENCY'
  THEN 'UNCONFIRMED_TERMINAL' ELSE gate END AS gate_reason,
  CAST(urgent IS NOT NULL AND v IS NOT NULL AS INTEGER) AS short_circuited FROM xa"""))
def alerts_extended(spark, sf) -> DataFrame:
    lanes, df = extended_rows(spark, sf)
    return R.evaluate_extended(lanes.done(df)).select(
        "series_id", "event_id", "tier", "rule_id", "brady_run_len", "gate_reason",
        F.col("short_circuited").cast("int").alias("short_circuited"))


@query("rule_registry")
def rule_registry(spark, sf) -> DataFrame:
    """The inventory against the inputs the event panel supplies; its size is the rule book's."""
    cols = event_panel(spark, sf).df.columns
    have = ["sbp", "dbp", "age", "weight", "cadence", "session_structure"] + (["pulse"] if "pulse" in cols else [])
    return R.registry(spark, have).select("rule_id", "tier", F.concat_ws(",", "blocked_by").alias("blocked_by"), "status",
                                          F.col("is_emergency").cast("int").alias("is_emergency"))


VALUES = ", ".join(f"('{r}', '{t}')" for r, t, _ in lines(RULE_TABLE))


@query("rule_coverage", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step") + "," + extended_sql() + f""",
reg AS (SELECT DISTINCT rule_id FROM (VALUES {VALUES}) v(rule_id, tier)),
fa AS (SELECT DISTINCT rule_id FROM al WHERE v IS NOT NULL), fb AS (SELECT DISTINCT rule_id FROM xa WHERE v IS NOT NULL)""", """
SELECT reg.rule_id, CAST(fa.rule_id IS NOT NULL AS INTEGER) AS fired_on_a, CAST(fb.rule_id IS NOT NULL AS INTEGER) AS fired_on_b,
  CASE WHEN fa.rule_id IS NOT NULL THEN 'observed' WHEN fb.rule_id IS NOT NULL THEN 'reachable only' ELSE 'never fired' END AS evidence
FROM reg LEFT JOIN fa ON reg.rule_id = fa.rule_id LEFT JOIN fb ON reg.rule_id = fb.rule_id"""))
def rule_coverage(spark, sf) -> DataFrame:
    lanes, a = event_alerts(spark, sf)
    other, df = extended_rows(spark, sf)
    c = R.coverage(R.registry(spark), lanes.done(a), R.evaluate_extended(other.done(df)))
    return c.select("rule_id", F.col("fired_on_a").cast("int").alias("fired_on_a"),
                    F.col("fired_on_b").cast("int").alias("fired_on_b"), "evidence")


@query("engine_summary", sql(SQL_EVENT_PANEL + "," + extended_sql(), f"""
SELECT series_id, count(*) AS n_rows, CAST(count(*) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS fired_count,
  CAST(count(*) FILTER (WHERE v IS NOT NULL AND {EMERGENCY}) AS BIGINT) AS emergency_count,
  arg_max(coalesce(tier, '-'), step) AS tier, arg_max(coalesce(rule_id, '-'), step) AS rule_id FROM xa GROUP BY 1"""))
def engine_summary(spark, sf) -> DataFrame:
    lanes, df = extended_rows(spark, sf)
    s = R.summary(R.evaluate_extended(lanes.done(df)))
    return s.select("series_id", "n_rows", "fired_count", "emergency_count",
                    F.coalesce("tier", F.lit("-")).alias("tier"), F.coalesce("rule_id", F.lit("-")).alias("rule_id"))


@query("tier_histogram", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step"), """
SELECT tier, rule_id, count(*) AS n FROM al WHERE v IS NOT NULL GROUP BY 1, 2"""))
def tier_histogram(spark, sf) -> DataFrame:
    lanes, a = event_alerts(spark, sf)
    return R.tier_counts(lanes.done(a))


def smoothed_forecast(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Newest prepared row per series, and three future rows at the level of the last seven values."""
    lanes, df = extended_rows(spark, sf)
    level = df.select("*", F.avg("sbp").over(lanes.rows(-6, 0)).alias("_level"),
                      (F.col("sbp") - F.lag("sbp", 6).over(lanes.window)).alias("_trend"))
    rows = lanes.done(level)
    last = rows.groupBy("series_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "series_id"]), "step").alias("l"))
    last = last.select("series_id", "l.*")
    ahead = P.schedule(last.withColumn("median_gap", F.lit(1.0)), 3).select(
        "series_id", "h", "days_ahead", "target_ts", (F.col("_level") + F.col("_trend") * (F.col("h") + 1) / 6.0).alias("sbp_hat"),
        F.col("dbp").alias("dbp_hat"))
    return last.drop("_level", "_trend"), ahead


@query("predicted_alerts")
def predicted_alerts(spark, sf) -> DataFrame:
    last, ahead = smoothed_forecast(spark, sf)
    return R.predicted_alerts(last, ahead).select("series_id", "h", r("sbp").alias("sbp"), r("dbp").alias("dbp"), "step",
                                                  "tier", "rule_id", "fired", "gate_reason")


SQL_AHEAD = """,
lv AS (SELECT series_id, step, dbp, avg(sbp) OVER (PARTITION BY series_id ORDER BY step ROWS 6 PRECEDING) AS lev,
  sbp - lag(sbp, 6) OVER (PARTITION BY series_id ORDER BY step) AS tr FROM ep),
ah AS (SELECT series_id, h, h + 1 AS days_ahead, lev + tr * (h + 1) / CAST(6 AS DOUBLE) AS sbp_hat
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY step DESC) AS rn FROM lv), (SELECT unnest([0, 1, 2]) AS h) WHERE rn = 1)"""


@query("drift_advisories", sql(SQL_PRIOR + SQL_AHEAD, f"""
SELECT a.series_id, CAST(min(h) + 1 AS DOUBLE) AS horizon_days,
  {sr('least(greatest(0.5 + (arg_min(sbp_hat, h) - min(threshold)) / 40, 0), 0.99)', 2)} AS confidence
FROM ah a JOIN thr t ON a.series_id = t.series_id WHERE sbp_hat >= threshold GROUP BY 1"""))
def drift_advisories(spark, sf) -> DataFrame:
    _, ahead = smoothed_forecast(spark, sf)
    lanes = event_panel(spark, sf)
    t = O.thresholds(lanes.done(lanes.df), EVENT_CONFIG, bound=event_rows(spark, sf))
    a = R.drift_advisories(ahead, t, bound=event_bound(spark, sf))
    return a.select("series_id", F.col("horizon_days").cast("double").alias("horizon_days"), r("confidence", 2).alias("confidence"))


def weight_like(lanes: Lanes) -> DataFrame:
    return lanes.df.withColumn("idwg", F.when(F.col("k") % 5 != 0, (F.col("weight") - 60) * 1.5))


@query("fluid_advisories", sql(SQL_EVENT_PANEL + """,
f0 AS (SELECT series_id, step, CASE WHEN k % 5 <> 0 THEN (weight - 60) * 1.5 END AS idwg FROM ep),
f1 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY step DESC) AS b FROM f0 WHERE idwg IS NOT NULL),
f2 AS (SELECT series_id, count(*) AS n, regr_slope(idwg, -b) AS slope, avg(idwg) FILTER (WHERE b <= 3) AS recent
  FROM f1 WHERE b <= 8 GROUP BY 1)""", f"""
SELECT series_id, {sr('round_even(least(greatest(0.4 + slope, 0), 0.95), 3)', 3)} AS confidence FROM f2
WHERE n >= 8 AND slope > 0.05 AND recent >= 3"""))
def fluid_advisories(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    return R.fluid_advisories(lanes, weight_like(lanes)).select("series_id", r("confidence", 3).alias("confidence"))


def advisories(spark, sf) -> DataFrame:
    _, ahead = smoothed_forecast(spark, sf)
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df)
    t = O.thresholds(rows, EVENT_CONFIG, bound=event_rows(spark, sf))
    newest = rows.groupBy("series_id").agg(F.max_by("sbp", "step").alias("sbp"), F.max_by("k", "step").alias("k"))
    flagged = newest.where(F.col("k") >= 60).withColumn("est_lead_days", F.lit(2.0))
    a = R.drift_advisories(ahead, t, bound=event_bound(spark, sf)).withColumn("horizon_days", F.col("horizon_days").cast("double"))
    b = R.fluid_advisories(lanes, weight_like(lanes))
    c = R.trend_advisories(flagged, confidence=F.lit(0.6))
    return a.unionByName(b).unionByName(c)


@query("arbitrated_advisories")
def arbitrated_advisories(spark, sf) -> DataFrame:
    lanes, al = event_alerts(spark, sf)
    newest = lanes.done(al).groupBy("series_id").agg(F.max_by("tier", "step").alias("tier"))
    return R.arbitrate(advisories(spark, sf), newest.where("tier IS NOT NULL"))


@query("arbitration_log")
def arbitration_log(spark, sf) -> DataFrame:
    lanes, al = event_alerts(spark, sf)
    newest = lanes.done(al).groupBy("series_id").agg(F.max_by("tier", "step").alias("tier"))
    return R.arbitration_log(R.arbitrate(advisories(spark, sf), newest.where("tier IS NOT NULL")))


@query("symptom_rollups", sql(SQL_EVENT_PANEL, """
SELECT series_id, event_id, greatest(dizziness, syncope, palpitations, face_swelling, dry_cough) AS sym_any,
  dizziness + syncope + palpitations + face_swelling + dry_cough AS sym_count, syncope AS sym_red_flag,
  greatest(dizziness, syncope, palpitations) AS sym_mech_hypotensive, greatest(face_swelling, dry_cough) AS sym_mech_drug,
  CASE WHEN sbp - 110 >= 20 AND greatest(dizziness, syncope, palpitations, face_swelling, dry_cough) = 1 THEN 1 ELSE 0 END AS idh_kdoqi
FROM ep"""))
def symptom_rollups(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    names = ["dizziness", "syncope", "palpitations", "face_swelling", "dry_cough"]
    df = lanes.done(lanes.df).select("series_id", "event_id", (F.col("sbp") - 110).alias("sbp_drop"),
                                     *[F.col(n).alias(f"sym_{n}") for n in names])
    return R.symptom_rollups(df, names).select("series_id", "event_id", "sym_any", "sym_count", "sym_red_flag",
                                               "sym_mech_hypotensive", "sym_mech_drug", "idh_kdoqi")


ACTIONS = {"view": "TIER1_ACKNOWLEDGED", "click": "TIER2_REVIEWED_NO_ACTION", "error": "TIER2_DEFERRED",
           "signup": "BP_L2_UNABLE_TO_REACH_RETRY"}


def labelled(spark, sf) -> DataFrame:
    lanes, al = event_alerts(spark, sf)
    act = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    df = lanes.done(al).where("fired").withColumn("disposition", act).withColumn(
        "disposition_lag_days", F.when(F.col("disposition").isNotNull(), (F.col("k") % 15).cast("int")))
    out = R.label_dispositions(df)
    return out.withColumn("second_label", F.when(F.col("k") % 10 == 0, F.when(
        F.col("event_id") % 6 == 0, 1 - F.col("binary_label")).otherwise(F.col("binary_label"))))


SQL_LABELLED = SQL_EVENT_PANEL + "," + base_sql("ep", "step") + """,
lb AS (SELECT *, CASE event_type WHEN 'view' THEN 'positive' WHEN 'click' THEN 'negative' WHEN 'error' THEN 'deferred'
    WHEN 'signup' THEN 'unreachable' END AS cls FROM al WHERE v IS NOT NULL),
lc AS (SELECT *, CASE cls WHEN 'deferred' THEN 0.4 WHEN 'unreachable' THEN 0 ELSE 1 END AS w,
  CASE WHEN cls IN ('positive', 'deferred') THEN 1 WHEN cls = 'negative' THEN 0 END AS y FROM lb),
ld AS (SELECT *, CASE WHEN k % 10 = 0 THEN CASE WHEN event_id % 6 = 0 THEN 1 - y ELSE y END END AS y2 FROM lc)"""


@query("disposition_labels", sql(SQL_LABELLED, f"""
SELECT cls AS disposition_class, count(*) AS n, {sr('sum(w)')} AS weight, CAST(sum(y) AS BIGINT) AS positives,
  CAST(max(CASE WHEN cls IS NOT NULL THEN CAST(ts AS DATE) + CAST(k % 15 AS INTEGER) END) AS VARCHAR) AS last_known FROM ld GROUP BY 1"""))
def disposition_labels(spark, sf) -> DataFrame:
    return labelled(spark, sf).groupBy("disposition_class").agg(
        F.count("*").alias("n"), r(F.sum("loss_weight")).alias("weight"), F.sum("binary_label").alias("positives"),
        F.max("label_available_at").cast("string").alias("last_known"))


@query("label_quality", sql(SQL_LABELLED, """
SELECT CAST(t AS VARCHAR) AS training_terminus, count(*) AS alerts_fired, count(cls) AS with_disposition_path,
  CAST(count(*) FILTER (WHERE CAST(ts AS DATE) > t) AS BIGINT) AS labels_not_yet_landed,
  CAST(count(*) FILTER (WHERE y IS NOT NULL AND y2 IS NOT NULL) AS BIGINT) AS double_reviewed,
  round_even(avg(CASE WHEN y IS NOT NULL AND y2 IS NOT NULL THEN CASE WHEN y = y2 THEN 1 ELSE 0 END END), 4) AS raw_agreement,
  round_even((avg(CASE WHEN y IS NOT NULL AND y2 IS NOT NULL THEN CASE WHEN y = y2 THEN 1 ELSE 0 END END) - 0.5) / 0.5, 3) AS kappa
FROM ld, (SELECT CAST(max(ts) AS DATE) - 14 AS t FROM ld) GROUP BY t"""))
def label_quality(spark, sf) -> DataFrame:
    q = R.label_quality(labelled(spark, sf))
    return q.withColumn("training_terminus", F.col("training_terminus").cast("string"))


TIER_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TIERS))


@query("fired_dispositions", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step") + f""",
t AS (SELECT * FROM (VALUES {TIER_VALUES}) v(tier_rank, tier)),
f AS (SELECT DISTINCT rule_id, tier FROM al WHERE v IS NOT NULL),
n AS (SELECT tier, count(*) AS n FROM f GROUP BY 1)""", """
SELECT CAST(tier_rank AS INTEGER) AS tier_rank, t.tier, CASE WHEN tier_rank < 5 THEN coalesce(n, 0) ELSE 0 END AS with_disposition,
  CASE WHEN tier_rank < 5 THEN 0 ELSE coalesce(n, 0) END AS without_disposition FROM t LEFT JOIN n ON t.tier = n.tier"""))
def fired_dispositions(spark, sf) -> DataFrame:
    """Of the rules that fired: how many end in a tier with a resolution path."""
    lanes, al = event_alerts(spark, sf)
    return R.disposition_coverage(lanes.done(al).where("fired").select("rule_id", "tier").distinct())


@query("classifier_labels", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step"), """
SELECT coalesce(b.tier, 'NO_ALERT') AS tier_label, count(*) AS n,
  CAST(count(*) FILTER (WHERE b.tier IS NULL AND coalesce(b.gate, 'NONE') = 'NONE') AS BIGINT) AS clean_negative,
  CAST(count(*) FILTER (WHERE b.tier IS NOT NULL OR coalesce(b.gate, 'NONE') = 'NONE') AS BIGINT) AS trainable
FROM al a LEFT JOIN (SELECT series_id, step, gate, CASE WHEN v IS NOT NULL THEN tier END AS tier FROM al) b
  ON a.series_id = b.series_id AND b.step = a.step + 1 GROUP BY 1"""))
def classifier_labels(spark, sf) -> DataFrame:
    lanes, al = event_alerts(spark, sf)
    rows = lanes.done(al)
    f = R.classifier_frame(rows.select("series_id", "step"), rows, 1)
    return f.groupBy("tier_label").agg(F.count("*").alias("n"), F.count_if("clean_negative").alias("clean_negative"),
                                       F.count_if("trainable").alias("trainable"))


@query("provenance", sql(SQL_EVENT_PANEL + "," + base_sql("ep", "step") + """,
ids AS (SELECT DISTINCT 'real' AS kind, CAST(series_id AS VARCHAR) AS id FROM al UNION ALL SELECT DISTINCT 'other', concat('s', s_suppkey) FROM supplier
  UNION ALL SELECT DISTINCT 'real_alerts', CAST(series_id AS VARCHAR) FROM al WHERE v IS NOT NULL UNION ALL SELECT DISTINCT 'other_alerts', concat('c', o_custkey) FROM orders),
ch AS (SELECT unnest([{'c': 'cohorts_disjoint', 'l': 'real', 'r': 'other', 'bad': true}, {'c': 'real_alerts_are_real', 'l': 'real_alerts', 'r': 'real', 'bad': false},
  {'c': 'other_alerts_are_other', 'l': 'other_alerts', 'r': 'other', 'bad': false}, {'c': 'no_other_id_in_real_alerts', 'l': 'real_alerts', 'r': 'other', 'bad': true}]) AS t),
of AS (SELECT t.c AS c, count(a.id) FILTER (WHERE (b.id IS NOT NULL) = t.bad) AS n FROM ch LEFT JOIN ids a ON a.kind = t.l LEFT JOIN ids b ON b.kind = t.r AND b.id = a.id
  GROUP BY 1)""", """
SELECT c AS "check", n AS n_offending, CAST(n = 0 AS INTEGER) AS holds FROM of"""))
def provenance_query(spark, sf) -> DataFrame:
    """Event series against suppliers under a prefix; alerts of the second cohort deliberately carry foreign ids."""
    lanes, al = event_alerts(spark, sf)
    rows = lanes.done(al)
    other = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return provenance({
        "real": rows.select(F.col("series_id").alias("id")), "other": other,
        "real_alerts": rows.where("fired").select(F.col("series_id").alias("id")),
        "other_alerts": table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"))})
