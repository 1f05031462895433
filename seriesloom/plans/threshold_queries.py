"""Queries over personal thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.operators import thresholds as O
from seriesloom.plans.registry import query
from seriesloom.plans.roles import EVENT_CONFIG as CFG, SQL_EVENT_PANEL, event_bound, event_panel, event_rows, r, sql, sr


def rows_of(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    return lanes.done(lanes.df)


SQL_PRIOR = SQL_EVENT_PANEL + """,
wm AS (SELECT * FROM ep WHERE step < 32),
pr AS (SELECT cohort_key, quantile_cont(sbp, 0.9) AS cohort FROM wm WHERE patient_split = 'fit' GROUP BY 1),
gp AS (SELECT quantile_cont(sbp, 0.9) AS g FROM wm WHERE patient_split = 'fit'),
pb AS (SELECT series_id, min(patient_split) AS patient_split, min(is_male) AS is_male, min(is_dm) AS is_dm,
  coalesce(min(age), 65) AS age, min(cohort_key) AS cohort_key, count(*) AS n, quantile_cont(sbp, 0.9) AS personal
  FROM wm GROUP BY 1),
bl AS (SELECT pb.*, coalesce(pr.cohort, gp.g) AS cohort, n / (n + CAST(30 AS DOUBLE)) AS w,
  n / (n + CAST(30 AS DOUBLE)) * personal + (1 - n / (n + CAST(30 AS DOUBLE))) * coalesce(pr.cohort, gp.g) AS blend
  FROM pb CROSS JOIN gp LEFT JOIN pr ON pb.cohort_key = pr.cohort_key WHERE n >= 5),
th AS (SELECT *, 140 + least(greatest(blend - 140, -25), 15) AS capv FROM bl),
thr AS (SELECT *, round_even(capv, 1) AS threshold FROM th)"""


@query("cohort_priors", sql(SQL_PRIOR, f"""
SELECT cohort_key, {sr('cohort')} AS prior FROM pr UNION ALL SELECT 'all', {sr('g')} FROM gp"""))
def cohort_priors(spark, sf) -> DataFrame:
    c, g = O.priors(O.warm_rows(rows_of(spark, sf), [CFG.warm]), [0.9], event_rows(spark, sf))
    return (c.select("cohort_key", r("cohort_q900").alias("prior"))
            .unionByName(g.select(F.lit("all").alias("cohort_key"), r("global_q900").alias("prior"))))


@query("personal_thresholds", sql(SQL_PRIOR, f"""
SELECT series_id, patient_split, cohort_key, n AS n_warm, {sr('capv', 4)} AS threshold, {sr('cohort', 4)} AS cohort,
  {sr('personal', 4)} AS personal, CAST(abs(blend - capv) > 1e-6 AS INTEGER) AS capped FROM th"""))
def personal_thresholds(spark, sf) -> DataFrame:
    panel, q = rows_of(spark, sf), [CFG.quantile]
    warm = O.warm_rows(panel, [CFG.warm])
    c, g = O.priors(warm, q, event_rows(spark, sf))
    b = O.with_priors(O.bands(warm, q), c, g, q).where("n >= 5")
    b = b.withColumn("_blend", O.blend("n", "personal_q900", "cohort_q900", CFG.shrink_k))
    b = b.withColumn("_cap", O.cap("_blend", CFG))
    return b.select("series_id", "patient_split", "cohort_key", F.col("n").alias("n_warm"),
                    r("_cap", 4).alias("threshold"), r("cohort_q900", 4).alias("cohort"),
                    r("personal_q900", 4).alias("personal"),
                    (F.abs(F.col("_blend") - F.col("_cap")) > 1e-6).cast("int").alias("capped"))


@query("threshold_caps", sql(SQL_PRIOR, """
SELECT count(*) AS n, CAST(count(*) FILTER (WHERE threshold < 180) AS BIGINT) AS below_floor,
  CAST(count(*) FILTER (WHERE threshold - 140 BETWEEN -25.000001 AND 15.000001) AS BIGINT) AS inside_caps FROM thr"""))
def threshold_caps(spark, sf) -> DataFrame:
    t = O.thresholds(rows_of(spark, sf), CFG, bound=event_rows(spark, sf))
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("threshold") < CFG.emergency_floor).alias("below_floor"),
                 F.count_if(F.col("offset").between(-CFG.cap_tighten - 1e-6, CFG.cap_loosen + 1e-6))
                 .alias("inside_caps"))


@query("observed_bands", sql(SQL_EVENT_PANEL, f"""
SELECT series_id, {sr('quantile_cont(sbp, 0.9)')} AS actual FROM ep WHERE step >= 32 GROUP BY 1"""))
def observed_bands(spark, sf) -> DataFrame:
    return O.observed_band(rows_of(spark, sf), CFG.warm, bound=event_bound(spark, sf)).select(
        "series_id", r("actual").alias("actual"))


SQL_GRID = SQL_EVENT_PANEL + """,
ws AS (SELECT unnest([16, 24, 32, 40]) AS warm), ks AS (SELECT unnest([10, 30, 60])::DOUBLE AS k),
qs AS (SELECT unnest([0.85, 0.90, 0.95])::DOUBLE AS q),
wm AS (SELECT ep.*, warm FROM ep JOIN ws ON step < warm),
pr AS (SELECT warm, cohort_key, quantile_cont(sbp, [0.85, 0.9, 0.95]) AS c FROM wm WHERE patient_split = 'fit' GROUP BY 1, 2),
pb AS (SELECT series_id, warm, min(cohort_key) AS cohort_key, count(*) AS n, quantile_cont(sbp, [0.85, 0.9, 0.95]) AS p
  FROM wm WHERE patient_split = 'fit' GROUP BY 1, 2 HAVING count(*) >= 5),
ac AS (SELECT series_id, warm, quantile_cont(sbp, 0.9) AS actual FROM ep JOIN ws ON step >= warm GROUP BY 1, 2),
al AS (SELECT pb.warm, k, q, n, actual, CASE q WHEN 0.85 THEN p[1] WHEN 0.9 THEN p[2] ELSE p[3] END AS personal,
  CASE q WHEN 0.85 THEN c[1] WHEN 0.9 THEN c[2] ELSE c[3] END AS cohort
  FROM pb JOIN pr ON pb.warm = pr.warm AND pb.cohort_key = pr.cohort_key
  JOIN ac ON pb.series_id = ac.series_id AND pb.warm = ac.warm CROSS JOIN ks CROSS JOIN qs)""" + """,
gr AS (SELECT CAST(warm AS INTEGER) AS warm, k, q, count(*) AS n,
  avg(abs(actual - round_even(140 + least(greatest(n / (n + k) * personal + (1 - n / (n + k)) * cohort - 140, -25), 15), 1))) AS mae_fit
  FROM al GROUP BY 1, 2, 3 HAVING count(*) >= 20)"""


@query("threshold_search", sql(SQL_GRID, f"SELECT warm, k, q, n, {sr('mae_fit', 2)} AS mae_fit FROM gr"))
def threshold_search(spark, sf) -> DataFrame:
    """Thresholds are rounded to one decimal before scoring."""
    s = O.search(rows_of(spark, sf), CFG, bound=event_bound(spark, sf), cohort_bound=event_rows(spark, sf))
    return s.select("warm", "k", "q", "n", r("mae_fit", 2).alias("mae_fit"))


@query("best_threshold_config", sql(SQL_GRID, f"SELECT warm, k, q, n, {sr('mae_fit', 2)} AS mae_fit FROM gr ORDER BY gr.mae_fit, warm, k, q LIMIT 1"))
def best_threshold_config(spark, sf) -> DataFrame:
    s = O.search(rows_of(spark, sf), CFG, bound=event_bound(spark, sf), cohort_bound=event_rows(spark, sf))
    return O.best_config(s).select("warm", "k", "q", "n", r("mae_fit", 2).alias("mae_fit"))


@query("threshold_scorecard", sql(SQL_PRIOR + """,
ac AS (SELECT series_id, quantile_cont(sbp, 0.9) AS actual FROM ep WHERE step >= 32 GROUP BY 1),
m AS (SELECT th.*, actual FROM th JOIN ac USING (series_id)),
l AS (SELECT 'learned (capped blend)' AS model, actual, capv AS raw FROM m
  UNION ALL SELECT 'personal only', actual, personal FROM m UNION ALL SELECT 'cohort only', actual, cohort FROM m
  UNION ALL SELECT 'population constant', actual, 140 FROM m),
c AS (SELECT *, 140 + least(greatest(raw - 140, -25), 15) AS p FROM l)""", f"""
SELECT model, count(*) AS n, {sr('avg(abs(actual - p))', 4)} AS mae,
  {sr('1 - sum((actual - p) * (actual - p)) / (sum(actual * actual) - count(*) * avg(actual) * avg(actual))', 4)} AS r2,
  {sr('avg(CASE WHEN abs(actual - p) <= 10 THEN 1 ELSE 0 END)', 4)} AS within_10,
  min(CASE WHEN abs(raw - p) <= 1e-8 + 1e-5 * abs(p) THEN 1 ELSE 0 END) AS legal_raw FROM c GROUP BY 1"""))
def threshold_scorecard(spark, sf) -> DataFrame:
    panel, q = rows_of(spark, sf), [CFG.quantile]
    warm = O.warm_rows(panel, [CFG.warm])
    c, g = O.priors(warm, q, event_rows(spark, sf))
    b = O.with_priors(O.bands(warm, q), c, g, q).where("n >= 5")
    b = b.select("series_id", O.cap(O.blend("n", "personal_q900", "cohort_q900", CFG.shrink_k), CFG).alias("threshold"),
                 F.col("personal_q900").alias("personal"), F.col("cohort_q900").alias("cohort"))
    m = b.join(O.observed_band(panel, CFG.warm, bound=event_bound(spark, sf)), "series_id")
    s = O.scorecard(m, CFG)
    return s.select("model", "n", *[r(c, 4).alias(c) for c in ("mae", "r2", "within_10")], "legal_raw")


def cut_frame(spark, sf) -> DataFrame:
    panel = rows_of(spark, sf)
    c, g = O.priors(O.warm_rows(panel, [CFG.warm]), [CFG.quantile], event_rows(spark, sf))
    return O.offset_split(O.cut_frame(panel, c, g, CFG))


SQL_CUTS = SQL_PRIOR + """,
cs AS (SELECT unnest([12, 20, 28, 36, 44, 52]) AS cut),
cx AS (SELECT series_id, cut, step, sbp, CASE WHEN step < cut THEN sbp END AS h, CASE WHEN step >= cut THEN sbp END AS f,
  CASE WHEN step BETWEEN cut - 10 AND cut - 1 THEN sbp END AS t10, CASE WHEN step BETWEEN cut - 20 AND cut - 1 THEN sbp END AS t20,
  patient_split, is_male, age, cohort_key FROM ep JOIN cs ON step < cut + 20),
cg AS (SELECT series_id, cut, min(patient_split) AS patient_split, min(cohort_key) AS cohort_key, count(h) AS hist_n,
  avg(h) AS hist_mean, stddev_samp(h) AS hist_sd, quantile_cont(h, 0.25) AS q25, quantile_cont(h, 0.5) AS q50,
  quantile_cont(h, 0.75) AS q75, quantile_cont(h, 0.9) AS q90, min(h) AS hist_min, max(h) AS hist_max, avg(t10) AS recent_mean10,
  stddev_samp(t10) AS recent_sd10, regr_slope(t20, step) FILTER (WHERE t20 IS NOT NULL) AS recent_slope20,
  quantile_cont(f, 0.9) AS y
  FROM cx GROUP BY 1, 2 HAVING max(step) + 1 >= cut + 10 AND count(h) >= 5 AND count(f) >= 8),
cf AS (SELECT cg.*, coalesce(pr.cohort, gp.g) AS cohort_prior,
  CASE WHEN patient_split = 'holdout' THEN 'holdout' WHEN b < 20 THEN 'calib' WHEN b < 40 THEN 'select' ELSE 'train' END AS part
  FROM (SELECT *, CAST(concat('0x', substr(md5(concat('offset-split:', series_id)), 1, 8)) AS BIGINT) % 100 AS b FROM cg) cg
  CROSS JOIN gp LEFT JOIN pr ON cg.cohort_key = pr.cohort_key)"""
STATS = ["hist_mean", "hist_sd", "hist_min", "hist_max", "recent_mean10", "recent_sd10", "recent_slope20", "cohort_prior", "y"]


@query("threshold_cuts", sql(SQL_CUTS, f"""
SELECT series_id, CAST(cut AS INTEGER) AS cut, part AS offset_split, CAST(hist_n AS DOUBLE) AS hist_n,
  {sr('q25')} AS hist_q25, {sr('q50')} AS hist_q50, {sr('q75')} AS hist_q75, {sr('q90')} AS hist_q90,
  {sr('q75 - q25')} AS hist_iqr, {sr('q90 - cohort_prior')} AS level_vs_cohort,
  {', '.join(f'{sr(c)} AS {c}' for c in STATS)} FROM cf"""))
def threshold_cuts(spark, sf) -> DataFrame:
    f = cut_frame(spark, sf)
    return f.select("series_id", "cut", "offset_split", "hist_n",
                    *[r(c).alias(c) for c in ["hist_q25", "hist_q50", "hist_q75", "hist_q90", "hist_iqr",
                                              "level_vs_cohort", *STATS]])


SQL_BLEND = SQL_CUTS + """,
v AS (SELECT var_samp(y - q90) AS s2, var_samp(q90 - cohort_prior) AS t2, quantile_cont(y - q90, 0.5) AS bias
  FROM cf WHERE part = 'train'),
b AS (SELECT least(greatest(s2 / greatest(t2, 1e-9), 1), 400) AS k, bias FROM v),
bb AS (SELECT cf.*, hist_n / (hist_n + k) * q90 + (1 - hist_n / (hist_n + k)) * cohort_prior + bias AS pred FROM cf, b)"""


@query("bayes_blend", sql(SQL_BLEND, f"SELECT series_id, CAST(cut AS INTEGER) AS cut, {sr('pred')} AS pred FROM bb"))
def bayes_blend(spark, sf) -> DataFrame:
    f = cut_frame(spark, sf)
    fitted = O.fit_bayes_blend(f.where("offset_split = 'train'"), event_rows(spark, sf))
    return O.predict_bayes_blend(f, fitted).select("series_id", "cut", r("pred").alias("pred"))


@query("threshold_board", sql(SQL_CUTS + """,
l AS (SELECT part, y, unnest([{'m': 'capped blend (reference)', 'p': hist_n / (hist_n + CAST(30 AS DOUBLE)) * q90
      + (1 - hist_n / (hist_n + CAST(30 AS DOUBLE))) * cohort_prior}, {'m': 'personal q90 only', 'p': q90},
    {'m': 'cohort prior only', 'p': cohort_prior}, {'m': 'population constant', 'p': CAST(140 AS DOUBLE)}]) AS u FROM cf),
c AS (SELECT part, y, u.m AS model, 140 + least(greatest(u.p - 140, -25), 15) AS p FROM l WHERE part IN ('select', 'holdout'))""", f"""
SELECT model, part AS offset_split, count(*) AS n, {sr('avg(greatest(0.9 * (y - p), -0.1 * (y - p)))')} AS pinball,
  {sr('avg(abs(y - p))')} AS mae, {sr('avg(CASE WHEN y <= p THEN 1 ELSE 0 END)')} AS coverage,
  {sr('avg(CASE WHEN abs(y - p) <= 10 THEN 1 ELSE 0 END)')} AS within10 FROM c GROUP BY 1, 2 HAVING count(*) >= 20"""))
def threshold_board(spark, sf) -> DataFrame:
    refs = O.reference_candidates(CFG.shrink_k, CFG)
    long = O.long_candidates(cut_frame(spark, sf), refs, {n: "reference" for n in refs}, CFG)
    b = O.board(long, CFG)
    return b.select("model", "offset_split", "n", *[r(c).alias(c) for c in ("pinball", "mae", "coverage", "within10")])
