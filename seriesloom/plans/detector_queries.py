"""Queries over event labels, detector scores, fusion, scorecards, metrics and gates on slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.skew import attach
from seriesloom.lineage import pin
from seriesloom.operators import detectors as D
from seriesloom.operators import features as W
from seriesloom.operators import metrics as M
from seriesloom.plans.feature_queries import SQL_EWM, sql_expand, sql_lag, sql_roll
from seriesloom.plans.registry import query
from seriesloom.plans.roles import (EVENT_CONFIG, SQL_EVENT_PANEL, event_bound, event_panel, event_rows, r, sql, sr, table)


def over_step(text: str) -> str:
    return text.replace("ORDER BY ts", "ORDER BY step")


FEATURES_SQL = over_step(f"""
fe AS (SELECT *, {sql_lag('sbp', 1)} AS l1, {sql_expand('avg', 'sbp')} AS m, {sql_expand('stddev_samp', 'sbp')} AS s,
  {sql_roll('avg', 'sbp', 7, 2)} AS m7 FROM ep),
et AS (SELECT series_id, quantile_cont(sbp, 0.95) AS thr FROM ep WHERE split = 'train' GROUP BY 1),
f3 AS (SELECT fe.*, thr, lead(sbp, 1) OVER w AS a1, lead(sbp, 2) OVER w AS a2, lead(sbp, 3) OVER w AS a3
  FROM fe LEFT JOIN et ON fe.series_id = et.series_id WINDOW w AS (PARTITION BY fe.series_id ORDER BY step)),
ds AS (SELECT *, CASE WHEN thr IS NULL THEN NULL WHEN a1 >= thr OR a2 >= thr OR a3 >= thr THEN 1
    WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL THEN 0 END AS event_next,
  CASE WHEN a1 >= thr THEN step + 1 WHEN a2 >= thr THEN step + 2 WHEN a3 >= thr THEN step + 3 END AS event_step,
  abs((l1 - m) / nullif(s, 0)) AS d_personal_z, m7 - m AS d_mean7_excess, l1 AS d_fixed_threshold FROM f3)""")
SQL_DS = SQL_EVENT_PANEL + "," + FEATURES_SQL


def detector_frame(spark, sf, dense: bool = False) -> DataFrame:
    """Features, event labels and closed-form plus sequential scores of every event row."""
    lanes = event_panel(spark, sf)
    thr = D.event_thresholds(lanes.done(lanes.df), bound=event_bound(spark, sf))
    df = attach(lanes.df, thr, "series_id", bound=lanes.longest)
    df = D.label_events(lanes, df, window=EVENT_CONFIG.warn_window).withColumn("_x", F.lag("sbp").over(lanes.window))
    df = D.cusum(lanes, df, "_x", {"d_cusum": 0.5})
    df = D.page_hinkley(lanes, df, "_x", {"d_page_hinkley": 0.05}).drop("_x")
    f = W.build_features(lanes, EVENT_CONFIG, df, dense=dense, smooth=False)         # mixtures start at rows of least hash
    return f.select("*", *D.column_scores())


SIMPLE = ["d_personal_z", "d_mean7_excess", "d_fixed_threshold"]
ALL = ["d_personal_z", "d_ewma_gap", "d_slope7", "d_mean7_excess", "d_cusum", "d_page_hinkley"]


@query("event_labels", sql(SQL_DS, f"SELECT series_id, event_id, {sr('thr')} AS event_threshold, event_next, event_step FROM ds"))
def event_labels(spark, sf) -> DataFrame:
    return detector_frame(spark, sf).select("series_id", "event_id", r("event_threshold").alias("event_threshold"),
                                            "event_next", "event_step")


@query("column_scores", sql(SQL_DS, "SELECT series_id, event_id, " + ", ".join(f"{sr(c)} AS {c}" for c in SIMPLE) + " FROM ds"))
def column_scores(spark, sf) -> DataFrame:
    return detector_frame(spark, sf).select("series_id", "event_id", *[r(c).alias(c) for c in SIMPLE])


SQL_CUSUM = SQL_EVENT_PANEL + """,
x0 AS (SELECT series_id, event_id, step, lag(sbp) OVER (PARTITION BY series_id ORDER BY step) AS x FROM ep),
x1 AS (SELECT *, avg(x) FILTER (WHERE step < 20) OVER (PARTITION BY series_id) AS m,
  stddev_pop(x) FILTER (WHERE step < 20) OVER (PARTITION BY series_id) AS s FROM x0),
c AS (SELECT series_id, event_id, step, CAST(0 AS DOUBLE) AS acc FROM x1 WHERE step = 0
  UNION ALL SELECT x1.series_id, x1.event_id, x1.step, CASE WHEN x1.x IS NULL THEN 0
    ELSE greatest(0, c.acc + (x1.x - x1.m) / x1.s - 0.5) END
  FROM c JOIN x1 ON c.series_id = x1.series_id AND x1.step = c.step + 1)"""


@query("cusum", sql("RECURSIVE " + SQL_CUSUM.strip(), f"SELECT series_id, event_id, {sr('acc')} AS d_cusum FROM c"))
def cusum(spark, sf) -> DataFrame:
    return detector_frame(spark, sf).select("series_id", "event_id", r("d_cusum").alias("d_cusum"))


SQL_PH = SQL_EVENT_PANEL + """,
x0 AS (SELECT series_id, event_id, step, lag(sbp) OVER (PARTITION BY series_id ORDER BY step) AS x FROM ep),
p AS (SELECT series_id, event_id, step, CAST(0 AS DOUBLE) AS mu, CAST(0 AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS low
    FROM x0 WHERE step = 0
  UNION ALL SELECT x0.series_id, x0.event_id, x0.step, p.mu + (x0.x - p.mu) / x0.step,
    p.t + x0.x - (p.mu + (x0.x - p.mu) / x0.step) - 0.05,
    least(coalesce(p.low, 1e300), p.t + x0.x - (p.mu + (x0.x - p.mu) / x0.step) - 0.05)
  FROM p JOIN x0 ON p.series_id = x0.series_id AND x0.step = p.step + 1)"""


@query("page_hinkley", sql("RECURSIVE " + SQL_PH.strip(),
                           f"SELECT series_id, event_id, {sr('coalesce(t - low, 0)')} AS d_page_hinkley FROM p"))
def page_hinkley(spark, sf) -> DataFrame:
    return detector_frame(spark, sf).select("series_id", "event_id", r("d_page_hinkley").alias("d_page_hinkley"))


@query("forecast_scores", sql(SQL_DS + """,
ow AS (SELECT series_id, avg(sbp) AS mu, stddev_samp(sbp) AS sd FROM ep WHERE split = 'train' GROUP BY 1)""", f"""
SELECT ds.series_id, event_id, {sr('(m7 - mu) / nullif(sd, 0)')} AS d_forecast_level, {sr('m7 - thr')} AS d_forecast_breach
FROM ds LEFT JOIN ow ON ds.series_id = ow.series_id"""))
def forecast_scores(spark, sf) -> DataFrame:
    f = D.forecast_scores(detector_frame(spark, sf), "sbp_mean7", bound=event_bound(spark, sf))
    return f.select("series_id", "event_id", r("d_forecast_level").alias("d_forecast_level"),
                    r("d_forecast_breach").alias("d_forecast_breach"))


def z_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest(({c} - m_{c}) / s_{c}, -8), 8) END"


SQL_FUSE = SQL_DS + """,
tr AS (SELECT avg(d_personal_z) AS m_d_personal_z, stddev_samp(d_personal_z) AS s_d_personal_z, avg(d_mean7_excess) AS m_d_mean7_excess,
  stddev_samp(d_mean7_excess) AS s_d_mean7_excess FROM ds WHERE split = 'train'),
z AS (SELECT series_id, event_id, """ + z_sql("d_personal_z") + " AS z1, " + z_sql("d_mean7_excess") + " AS z2 FROM ds, tr)"


@query("fused_scores", sql(SQL_FUSE, f"""
SELECT series_id, event_id, {sr('coalesce((z1 + z2) / 2, z1, z2)')} AS d_fuse_mean, {sr('greatest(z1, z2)')} AS d_fuse_max,
  {sr('coalesce((z1 + z2) / 2, z1, z2)')} AS d_fuse_median FROM z"""))
def fused_scores(spark, sf) -> DataFrame:
    f = D.fuse(detector_frame(spark, sf), SIMPLE)
    return f.select("series_id", "event_id", *[r(c).alias(c) for c in ("d_fuse_mean", "d_fuse_max", "d_fuse_median")])


@query("fused_weighted")
def fused_weighted(spark, sf) -> DataFrame:
    f = pin(detector_frame(spark, sf).select("series_id", "event_id", "split", "event_next", *ALL))       # three scans follow
    w = D.fusion_weights(f, ALL, event_rows(spark, sf))
    return D.fuse(f, ALL, w).select("series_id", "event_id", "d_fuse_trimmed", "d_fuse_weighted")


def sql_ranking(source: str, by: str, score: str, label: str) -> str:
    return f"""
rk0 AS (SELECT {by} AS grp, {score} AS sc, sum({label}) AS p, sum(1 - {label}) AS n FROM {source}
  WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY 1, 2),
rk1 AS (SELECT *, sum(p) OVER (PARTITION BY grp ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS cp,
  sum(n) OVER (PARTITION BY grp ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS cn FROM rk0),
rk AS (SELECT grp, CAST(sum(p) + sum(n) AS BIGINT) AS n, sum(p) / CAST(sum(p) + sum(n) AS DOUBLE) AS base_rate,
  sum(n * (cp - p / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc_roc,
  sum(p * cp / CAST(cp + cn AS DOUBLE)) / sum(p) AS auc_pr FROM rk1 GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0)"""


SQL_LONG = SQL_DS + ", lg AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS detector, {c} AS score, event_next, event_step, step, days_since_last FROM ds" for c in SIMPLE) + ")"


@query("ranking_metrics", sql(SQL_LONG + "," + sql_ranking("lg", "detector", "score", "event_next"), f"""
SELECT grp AS detector, n, {sr('base_rate')} AS base_rate, {sr('auc_roc')} AS auc_roc, {sr('auc_pr')} AS auc_pr,
  {sr('auc_pr / base_rate')} AS auc_pr_lift FROM rk"""))
def ranking_metrics(spark, sf) -> DataFrame:
    long = W.unpivot(detector_frame(spark, sf), SIMPLE, "detector", "score", ["event_next"])
    m = M.ranking(long, ["detector"], "score", "event_next", event_rows(spark, sf))
    return m.select("detector", "n", *[r(c).alias(c) for c in ("base_rate", "auc_roc", "auc_pr", "auc_pr_lift")])


@query("toxicity_ranking", sql("""
tx AS (SELECT toxic, length(text) AS score, lang FROM labels JOIN documents USING (doc_id)),""".strip()
                               + sql_ranking("tx", "lang", "score", "toxic"), f"""
SELECT grp AS lang, n, {sr('auc_roc')} AS auc_roc, {sr('auc_pr')} AS auc_pr FROM rk WHERE n >= 5"""))
def toxicity_ranking(spark, sf) -> DataFrame:
    """Labels of documents ranked by text length: the metric on a binary label given as a table."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("score"))
    t = table(spark, sf, "labels").select("doc_id", "toxic").join(d, "doc_id")
    m = M.ranking(t, ["lang"], "score", "toxic", least=5)
    return m.select("lang", "n", r("auc_roc").alias("auc_roc"), r("auc_pr").alias("auc_pr"))


@query("detector_scorecard", sql(SQL_LONG + """,
kn AS (SELECT * FROM lg WHERE score IS NOT NULL AND event_next IS NOT NULL),
cu AS (SELECT detector, b AS budget_pct, quantile_cont(score, [0.99, 0.98, 0.95, 0.9])[i] AS cut FROM kn,
  (VALUES (1, 1), (2, 2), (3, 5), (4, 10)) v(i, b) GROUP BY 1, 2, i),
fl AS (SELECT kn.*, budget_pct, score >= cut AS flag FROM kn JOIN cu ON kn.detector = cu.detector),
sc AS (SELECT detector, budget_pct, CAST(count(*) FILTER (WHERE flag AND event_next = 1) AS DOUBLE) AS tp,
  count(*) FILTER (WHERE flag AND event_next = 0) AS fp, count(*) FILTER (WHERE NOT flag AND event_next = 1) AS fn,
  avg(event_next) AS base, quantile_cont(days_since_last, 0.5) FILTER (WHERE flag AND event_next = 1) AS gap,
  quantile_cont(event_step - step, 0.9) FILTER (WHERE flag AND event_next = 1) AS l90 FROM fl GROUP BY 1, 2)""", f"""
SELECT detector, CAST(budget_pct AS INTEGER) AS budget_pct, {sr('tp / (tp + fp)')} AS precision, {sr('tp / (tp + fn)')} AS recall,
  {sr('tp / (tp + fp) / base')} AS lift, {sr('l90 * gap')} AS lead_days_p90 FROM sc"""))
def detector_scorecard(spark, sf) -> DataFrame:
    s = D.scorecard(detector_frame(spark, sf), SIMPLE, 3.0, bound=3 * event_rows(spark, sf))
    return s.select("detector", "budget_pct", *[r(c).alias(c) for c in ("precision", "recall", "lift", "lead_days_p90")])


@query("serving_detector")
def serving_detector(spark, sf) -> DataFrame:
    """Chosen on validation rows alone; the running detectors need a series' whole history and are not served."""
    f = detector_frame(spark, sf).where("split = 'val'")
    serveable = [d for d in ALL if d not in ("d_cusum", "d_page_hinkley")]
    return D.choose(D.scorecard(f, [*serveable, D.REFERENCE], 3.0, bound=7 * event_rows(spark, sf)), 5, serveable)


_SHIPPED: dict[tuple, str] = {}


def shipped_detector(spark, sf) -> str:
    """The one detector that banners, fairness and gates use: ``serving_detector``, chosen once a session."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _SHIPPED:
        best = serving_detector(spark, sf).first()
        _SHIPPED[at] = best["detector"] if best else "d_personal_z"
    return _SHIPPED[at]


@query("anomaly_timeline", sql(SQL_DS + """,
cu AS (SELECT quantile_cont(d_personal_z, 0.95) AS cut FROM ds WHERE split = 'val')""", """
SELECT series_id, event_id, CAST(coalesce(step >= 7 AND d_personal_z >= cut, false) AS INTEGER) AS flagged FROM ds, cu"""))
def anomaly_timeline(spark, sf) -> DataFrame:
    f = detector_frame(spark, sf)
    t = D.timeline(f, "d_personal_z", D.serving_cut(f, "d_personal_z", 5, event_rows(spark, sf)))
    return t.select("series_id", "event_id", F.col("flagged").cast("int").alias("flagged"))


OOD = ["l1", "m7", "dbp", "pulse"]
SQL_OOD = SQL_DS + ", md AS (SELECT " + ", ".join(f"median({c}) AS md_{c}" for c in OOD) + " FROM ds WHERE split = 'train'), sc AS (SELECT " + ", ".join(
    f"greatest(coalesce(nullif(1.4826 * median(abs({c} - md_{c})), 0), 1), 1e-6) AS sc_{c}" for c in OOD) + (
    " FROM ds, md WHERE split = 'train'), z AS (SELECT series_id, event_id, split, list_avg(list_filter([")  + ", ".join(
    f"abs({c} - md_{c}) / sc_{c}" for c in OOD) + "], lambda x: x IS NOT NULL)) AS ood FROM ds, md, sc), cu AS (SELECT quantile_cont(ood, 0.99) AS cut FROM z WHERE split = 'train')"


@query("abstention", sql(SQL_OOD, f"""
SELECT split, count(*) AS n, {sr('avg(ood)')} AS mean_distance,
  CAST(count(*) FILTER (WHERE ood > cut) AS BIGINT) AS n_abstained FROM z, cu GROUP BY 1"""))
def abstention(spark, sf) -> DataFrame:
    columns = ["sbp_lag1", "sbp_mean7", "dbp", "pulse"]
    f = pin(detector_frame(spark, sf).select("split", *columns))                                           # five scans follow
    a = D.abstention(f, columns, bound=4 * event_rows(spark, sf))
    return a.groupBy("split").agg(F.count("*").alias("n"), r(F.avg("ood")).alias("mean_distance"),
                                  F.count_if("abstains").alias("n_abstained"))


# ---- metrics on forecasts and probabilities ---------------------------------------------------------

SQL_BASE = SQL_EVENT_PANEL + "," + over_step(f"""
b0 AS (SELECT series_id, event_id, step, split, age, is_male, is_dm, segment, sbp, lead(sbp, 1) OVER w AS y1, lead(sbp, 2) OVER w AS y2,
  {sql_lag('sbp', 1)} AS l1, {sql_lag('sbp', 2)} AS l2, {sql_lag('sbp', 7)} AS l7, {sql_expand('avg', 'sbp')} AS m,
  {sql_roll('avg', 'sbp', 7, 2)} AS m7, {sql_roll('stddev_samp', 'sbp', 7, 2)} AS s7 FROM ep
  WINDOW w AS (PARTITION BY series_id ORDER BY step)),
fc AS (SELECT series_id, event_id, step, split, segment, is_male, l1, u.h AS h, u.y AS y, u.model AS model, u.p AS p
  FROM (SELECT *, unnest([""" + ", ".join(
    f"{{'h': {h}, 'y': {y}, 'model': '{n}', 'p': {p}}}" for h, y in ((0, "sbp"), (1, "y1"), (2, "y2"))
    for n, p in (("persistence", "l1"), ("seasonal_naive_7", "l7"), ("drift", f"l1 + {h} * (l1 - l2)"), ("personal_mean", "m")))
    + """]) AS u FROM b0))""")


SQL_ALL_BASE = SQL_EWM.format(base=SQL_BASE.strip(), value="sbp", source="ep") + """,
fa AS (SELECT * FROM fc UNION ALL SELECT fc.* REPLACE ('ewma' AS model, e.y3 AS p)
  FROM fc JOIN e ON fc.series_id = e.series_id AND fc.step = e.step WHERE model = 'persistence')"""


def baseline_forecasts(spark, sf) -> DataFrame:
    from seriesloom.operators.forecast import baselines_long
    lanes = event_panel(spark, sf)
    return baselines_long(W.build_features(lanes, EVENT_CONFIG), "sbp", (0, 1, 2),
                          ["series_id", "event_id", "step", "split", "segment", "is_male", "sbp_lag1"])


@query("baseline_forecasts", sql(SQL_ALL_BASE, f"""
SELECT series_id, event_id, CAST(h AS INTEGER) AS h, model, {sr('y')} AS y, {sr('p')} AS p FROM fa"""))
def baseline_forecast_rows(spark, sf) -> DataFrame:
    f = baseline_forecasts(spark, sf)
    return f.select("series_id", "event_id", "h", "model", r("y").alias("y"), r("p").alias("p"))


@query("forecast_metrics", sql(SQL_ALL_BASE + """,
k AS (SELECT *, y - l1 AS dt, p - l1 AS dp FROM fa WHERE y IS NOT NULL AND p IS NOT NULL)""", f"""
SELECT model, CAST(h AS INTEGER) AS h, split, count(*) AS n, {sr('avg(abs(p - y))')} AS mae, {sr('sqrt(avg((p - y) * (p - y)))')} AS rmse,
  {sr('1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0)')} AS r2, {sr('avg(p - y)')} AS bias, {sr('stddev_pop(y)')} AS target_sd,
  {sr('CASE WHEN max(abs(dp)) > 1e-9 THEN avg(CASE WHEN abs(dt) > 1e-9 THEN CASE WHEN sign(dt) = sign(dp) THEN 1 ELSE 0 END END) END')} AS direction
FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 10"""))
def forecast_metrics(spark, sf) -> DataFrame:
    f = baseline_forecasts(spark, sf)
    m = M.evaluate(f, ["model", "h", "split"], last="sbp_lag1")
    return m.select("model", "h", "split", "n", *[r(c).alias(c) for c in ("mae", "rmse", "r2", "bias", "target_sd", "direction")])


def sql_resampled(source: str, by: str, value: str, key: str, prefix: str = "", seed: int = 42, draws: int = 200) -> str:
    """Poisson resampling as SQL: ``<prefix>rs`` has by, n, mean, lo, hi of ``value`` in ``source``."""
    h = lambda text: f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) % {M.PRIME}"
    weight = " + ".join(f"CASE WHEN u >= {e!r} THEN 1 ELSE 0 END" for e in M.POISSON_ONE)
    return f"""
{prefix}dr AS (SELECT d, greatest({h(f"concat('{seed}:', d, ':a')")}, 1) AS a, {h(f"concat('{seed}:', d, ':b')")} AS b FROM range({draws}) t(d)),
{prefix}rw AS (SELECT {by}, CAST({value} AS DOUBLE) AS v, {h(f"CAST({key} AS VARCHAR)")} AS x FROM {source} WHERE {value} IS NOT NULL),
{prefix}wt AS (SELECT {by}, d, v, {weight} AS w FROM (SELECT {by}, d, v, ((a * x + b) % {M.PRIME}) / CAST({M.PRIME} AS DOUBLE) AS u FROM {prefix}rw, {prefix}dr)),
{prefix}rs AS (SELECT {by}, max(n) AS n, max(m) AS mean, quantile_cont(q, 0.025) AS lo, quantile_cont(q, 0.975) AS hi FROM (
  SELECT {by}, d, count(*) AS n, avg(v) AS m, sum(w * v) / sum(w) AS q FROM {prefix}wt GROUP BY {by}, d) GROUP BY {by})"""


@query("resampled_errors", sql(SQL_ALL_BASE + """,
er AS (SELECT model, h, event_id, abs(y - p) AS err FROM fa WHERE split = 'test'),""" + sql_resampled("er", "model, h", "err", "event_id"), f"""
SELECT model, CAST(h AS INTEGER) AS h, n, {sr('mean')} AS mean, {sr('lo')} AS lo, {sr('hi')} AS hi FROM rs WHERE n >= 10"""))
def resampled_errors(spark, sf) -> DataFrame:
    """MAE with a resampling interval, per model and horizon."""
    f = baseline_forecasts(spark, sf).where("split = 'test'").withColumn("err", F.abs(F.col("y") - F.col("p")))
    return M.resampled_mean(f, ["model", "h"], "err", ["event_id"]).select("model", "h", "n", *[r(c).alias(c) for c in ("mean", "lo", "hi")])


@query("paired_errors", sql(SQL_ALL_BASE + """,
er AS (SELECT event_id, h, max(abs(y - p)) FILTER (WHERE model = 'personal_mean') - max(abs(y - p)) FILTER (WHERE model = 'persistence') AS d
  FROM fa WHERE split = 'test' GROUP BY 1, 2),""" + sql_resampled("er", "h", "d", "event_id"), f"""
SELECT CAST(h AS INTEGER) AS h, n, {sr('mean')} AS delta, {sr('lo')} AS lo, {sr('hi')} AS hi,
  CASE WHEN hi < 0 THEN 'learned model' ELSE 'BASELINE' END AS verdict FROM rs WHERE n >= 30"""))
def paired_errors(spark, sf) -> DataFrame:
    """Paired error difference of the personal mean against persistence, with a ship verdict."""
    f = baseline_forecasts(spark, sf).where("split = 'test' AND model IN ('persistence', 'personal_mean')")
    e = f.groupBy("event_id", "h").pivot("model", ["persistence", "personal_mean"]).agg(F.max(F.abs(F.col("y") - F.col("p"))))
    d = M.paired(e, ["h"], "personal_mean", "persistence", ["event_id"])
    return d.select("h", "n", *[r(c).alias(c) for c in ("delta", "lo", "hi")], F.when(F.col("hi") < 0, "learned model").otherwise("BASELINE").alias("verdict"))


@query("slice_gate", sql(SQL_BASE + """,
k AS (SELECT segment, is_male, abs(y - m) AS e, abs(y - l1) AS b FROM (SELECT *, y1 AS y FROM b0)
  WHERE split = 'test' AND y1 IS NOT NULL AND m IS NOT NULL),
s AS (SELECT 'segment' AS axis, segment AS level, count(*) AS n, avg(e) AS v, avg(b) AS ref FROM k GROUP BY segment
  UNION ALL SELECT 'is_male', CAST(is_male AS VARCHAR), count(*), avg(e), avg(b) FROM k GROUP BY is_male),
t AS (SELECT avg(e) AS ov, avg(b) - avg(e) AS os FROM k)""", f"""
SELECT axis, level, n, {sr('v')} AS value, {sr('ref')} AS reference, {sr('ref - v')} AS score, {sr('v - ov')} AS raw_gap,
  {sr('ref - v - os')} AS gap, CAST(abs(ref - v - os) <= 1.5 AS INTEGER) AS passes FROM s, t WHERE n >= 30"""))
def slice_gate(spark, sf) -> DataFrame:
    """Improvement over the slice's own baseline, per segment and sex, by one grouping-sets pass."""
    lanes = event_panel(spark, sf)
    f = W.build_features(lanes, EVENT_CONFIG)
    rows = f.where("split = 'test' AND y_sbp_h1 IS NOT NULL AND sbp_base_mean IS NOT NULL")
    g = M.slice_gate(rows, ["segment", "is_male"], F.avg(F.abs(F.col("y_sbp_h1") - F.col("sbp_base_mean"))), 1.5, "MAE",
                     reference=F.avg(F.abs(F.col("y_sbp_h1") - F.col("sbp_lag1"))))
    return g.select("axis", "level", "n", *[r(c).alias(c) for c in ("value", "reference", "score", "raw_gap", "gap")],
                    F.col("passes").cast("int").alias("passes"))


SQL_PROB = SQL_DS + """,
pb AS (SELECT event_id, series_id, segment, event_next AS y, least(greatest((l1 - 90) / CAST(100 AS DOUBLE), 0.01), 0.99) AS p
  FROM ds WHERE event_next IS NOT NULL AND l1 IS NOT NULL)"""


def probabilities(spark, sf) -> DataFrame:
    """A crude probability from the last value, for the probability metrics."""
    f = detector_frame(spark, sf).where("event_next IS NOT NULL AND sbp_lag1 IS NOT NULL")
    p = F.least(F.greatest((F.col("sbp_lag1") - 90) / 100.0, F.lit(0.01)), F.lit(0.99))
    return f.select("event_id", "series_id", "segment", F.col("event_next").alias("y"), p.alias("p"))


@query("calibration_error", sql(SQL_PROB + """,
ed AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM pb),
bn AS (SELECT len(list_filter(e, lambda x: x < p)) AS b, p, y FROM pb, ed),
g AS (SELECT b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM bn GROUP BY 1)""", f"""
SELECT CAST(sum(n) AS BIGINT) AS n, {sr('sum(n * abs(c - a)) / sum(n)')} AS ece FROM g"""))
def calibration_error(spark, sf) -> DataFrame:
    return M.calibration_error(probabilities(spark, sf), "y", "p", bound=event_rows(spark, sf)).select("n", r("ece").alias("ece"))


@query("operating_point", sql(SQL_PROB + "," + sql_ranking("pb", "1", "p", "y") + """,
c AS (SELECT CAST(count(*) FILTER (WHERE p >= 0.4 AND y = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE p >= 0.4 AND y = 0) AS fp,
  count(*) FILTER (WHERE p < 0.4 AND y = 1) AS fn, CAST(count(*) FILTER (WHERE p < 0.4 AND y = 0) AS DOUBLE) AS tn, count(*) AS n, avg(y) AS prevalence,
  avg((p - y) * (p - y)) AS brier FROM pb)""", f"""
SELECT c.n, {sr('prevalence')} AS prevalence, {sr('brier')} AS brier, {sr('tp / (tp + fn)')} AS sensitivity, {sr('tn / (tn + fp)')} AS specificity,
  {sr('tp / (tp + fp)')} AS ppv, {sr('tn / (tn + fn)')} AS npv, {sr('(tp + fp) / tp')} AS nna, {sr('auc_roc')} AS auc_roc, {sr('auc_pr')} AS auc_pr
FROM c, rk"""))
def operating_point(spark, sf) -> DataFrame:
    o = M.operating_point(probabilities(spark, sf), "y", "p", 0.4, event_rows(spark, sf))
    return o.select("n", *[r(c).alias(c) for c in ("prevalence", "brier", "sensitivity", "specificity", "ppv", "npv", "nna", "auc_roc", "auc_pr")])


@query("decision_curve", sql(SQL_PROB + """,
t AS (SELECT CAST(0.05 * i AS DOUBLE) AS t FROM (SELECT unnest([1, 2, 4, 6, 8]) AS i)),
g AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp,
  avg(y) AS prev FROM pb, t GROUP BY 1)""", f"""
SELECT {sr('t')} AS threshold, {sr('tp / CAST(n AS DOUBLE) - fp / CAST(n AS DOUBLE) * t / (1 - t)')} AS net_benefit,
  {sr('prev - (1 - prev) * t / (1 - t)')} AS nb_treat_all FROM g"""))
def decision_curve(spark, sf) -> DataFrame:
    c = M.decision_curve(probabilities(spark, sf), "y", "p", [0.05, 0.1, 0.2, 0.3, 0.4])
    return c.select(*[r(x).alias(x) for x in ("threshold", "net_benefit", "nb_treat_all")])


@query("elicitation", sql(SQL_PROB + """,
g AS (SELECT k, count(*) AS n, CAST(count(*) FILTER (WHERE p >= 1 / CAST(k AS DOUBLE) AND y = 1) AS DOUBLE) AS tp,
  count(*) FILTER (WHERE p >= 1 / CAST(k AS DOUBLE) AND y = 0) AS fp, count(*) FILTER (WHERE p < 1 / CAST(k AS DOUBLE) AND y = 1) AS fn
  FROM pb, (SELECT unnest([3, 5, 10, 15, 20]) AS k) GROUP BY 1)""", f"""
SELECT CAST(k AS INTEGER) AS nna, {sr('round_even(1 / CAST(k AS DOUBLE), 3)')} AS implied_p_t, {sr('tp / (tp + fn)')} AS sensitivity,
  {sr('tp / (tp + fp)')} AS ppv, {sr('(tp + fp) / n * 3')} AS alerts_per_week FROM g"""))
def elicitation(spark, sf) -> DataFrame:
    e = M.elicitation(probabilities(spark, sf), "y", "p", 3.0)
    return e.select("nna", *[r(c).alias(c) for c in ("implied_p_t", "sensitivity", "ppv", "alerts_per_week")])


@query("rare_event_metrics", sql(SQL_PROB + "," + sql_ranking("pb", "segment", "p", "y") + """,
c AS (SELECT segment, CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, avg(y) AS base, avg((p - y) * (p - y)) AS brier, avg(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS alert_rate
  FROM pb GROUP BY 1)""", f"""
SELECT segment, {sr('brier')} AS brier, {sr('alert_rate')} AS alert_rate, {sr('tp / nullif(tp + fp, 0)')} AS precision,
  {sr('tp / nullif(tp + fn, 0)')} AS recall, {sr('1 - brier / (base * (1 - base))')} AS brier_skill, {sr('auc_pr / base_rate')} AS auc_pr_lift
FROM c JOIN rk ON segment = grp"""))
def rare_event_metrics(spark, sf) -> DataFrame:
    m = M.rare_event(probabilities(spark, sf).withColumn("cut", F.lit(0.5)), ["segment"], "y", "p", "cut", event_rows(spark, sf))
    return m.select("segment", *[r(c).alias(c) for c in ("brier", "alert_rate", "precision", "recall", "brier_skill", "auc_pr_lift")])


@query("subgroup_spread", sql(SQL_PROB + "," + sql_ranking("pb", "segment", "p", "y"), f"""
SELECT 'event' AS label, count(*) AS n_levels, {sr('max(auc_pr) - min(auc_pr)')} AS spread,
  CAST(max(auc_pr) - min(auc_pr) <= 0.15 AS INTEGER) AS passes FROM rk WHERE n >= 50"""))
def subgroup_spread(spark, sf) -> DataFrame:
    p = probabilities(spark, sf).withColumn("label", F.lit("event"))
    s = M.subgroup_spread(p, "label", "segment", "y", "p", bound=event_rows(spark, sf))
    return s.select("label", "n_levels", r("spread").alias("spread"), F.col("passes").cast("int").alias("passes"))


@query("error_concentration", sql(SQL_BASE + """,
e AS (SELECT series_id, avg(abs(y1 - l1)) AS e FROM b0 WHERE y1 IS NOT NULL AND l1 IS NOT NULL GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY e DESC, series_id) AS rn, sum(e) OVER (ORDER BY e DESC, series_id ROWS UNBOUNDED PRECEDING) AS cum,
  count(*) OVER () AS n, sum(e) OVER () AS t FROM e)""", f"""
SELECT q AS top_share, CAST(rn AS INTEGER) AS n_entities, {sr('cum / t')} AS error_share
FROM c, (SELECT unnest([0.05, 0.1, 0.25, 0.5])::DOUBLE AS q) WHERE rn = greatest(1, CAST(round_even(q * n, 0) AS INTEGER))"""))
def error_concentration(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    f = W.build_features(lanes, EVENT_CONFIG).withColumn("err", F.abs(F.col("y_sbp_h1") - F.col("sbp_lag1")))
    c = M.concentration(f, "series_id", "err", bound=event_rows(spark, sf))
    return c.select("top_share", "n_entities", r("error_share").alias("error_share"))


@query("fairness_battery")
def fairness_battery(spark, sf) -> DataFrame:
    """Forecast error, detector recall and detector precision per slice; only the first two gate."""
    name, axes = shipped_detector(spark, sf), ["segment", "is_male", "is_dm"]
    f = pin(detector_frame(spark, sf).where("split IN ('val', 'test')").select(                            # several scans follow
        "split", "step", *axes, name, "event_next", "y_sbp_h1", "sbp_base_mean", "sbp_ewm30"))
    t = D.timeline(f, name, D.serving_cut(f, name, 5, event_rows(spark, sf))).where("split = 'test'")
    err = t.where("y_sbp_h1 IS NOT NULL AND sbp_ewm30 IS NOT NULL")
    a = M.slice_gate(err, axes, F.avg(F.abs(F.col("y_sbp_h1") - F.col("sbp_base_mean"))), 1.5, "forecast MAE",
                     reference=F.avg(F.abs(F.col("y_sbp_h1") - F.col("sbp_ewm30"))))
    ev = t.where("event_next IS NOT NULL")
    hit = F.col("flagged") & (F.col("event_next") == 1)
    b = M.slice_gate(ev, axes, F.count_if(hit) / F.nullif(F.count_if(F.col("event_next") == 1), F.lit(0)), 0.05,
                     "detector recall", higher_is_better=True)
    c = M.slice_gate(ev, axes, F.count_if(hit) / F.nullif(F.count_if("flagged"), F.lit(0)), 0.05, "detector precision",
                     reference=F.avg("event_next"), higher_is_better=True).withColumn("passes", F.lit(True))
    return a.unionByName(b).unionByName(c)


@query("chained_board")
def chained_board(spark, sf) -> DataFrame:
    p = probabilities(spark, sf)
    rate = p.groupBy("series_id").agg(F.avg("y").alias("rate"))
    rows = p.join(rate, "series_id").withColumn("chained", (F.col("p") + F.col("rate")) / 2)
    return M.chain_board(rows, ["segment"], "y", "p", "chained", "rate", ["event_id"])
