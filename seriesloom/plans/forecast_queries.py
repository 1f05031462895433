"""Queries over forecasters, back-tests, bands, coherence, selection and learned models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.lanes import attach_row, lay_out
from seriesloom.functions.quantile import quantiles
from seriesloom.functions.skew import attach
from seriesloom.lineage import pin
from seriesloom.operators import densities as N
from seriesloom.operators import detectors as D
from seriesloom.operators import features as W
from seriesloom.operators import forecast as B
from seriesloom.operators import heads as R
from seriesloom.operators import learners as L
from seriesloom.operators import linear as G
from seriesloom.operators import metrics as M
from seriesloom.operators import panel as P
from seriesloom.operators import selection as X
from seriesloom.operators import stacking as K
from seriesloom.operators import stats as A
from seriesloom.operators import thresholds as O
from seriesloom.plans.detector_queries import SQL_ALL_BASE, SQL_BASE, baseline_forecasts, detector_frame, over_step, sql_resampled
from seriesloom.plans.feature_queries import sql_expand, sql_lag, sql_roll
from seriesloom.plans.registry import query
from seriesloom.plans.roles import (EVENT_CONFIG as CFG, SQL_EVENT_PANEL, event_bound, event_panel, event_rows, r, sql, sr)
from seriesloom.plans.rule_queries import event_alerts
from seriesloom.plans.threshold_queries import SQL_BLEND, SQL_PRIOR, cut_frame

SMALL = ["sbp_lag1", "sbp_lag2", "sbp_lag3", "sbp_mean7", "sbp_mean14", "sbp_std7", "sbp_base_mean", "sbp_ewm30", "dbp_lag1",
         "dbp_mean7", "gap_mean24", "age", "is_male"]
LAGS = [f"sbp_lag{k}" for k in (1, 2, 3, 5, 7, 14)]
ROW = ["series_id", "event_id", "step", "segment"]


def frame(spark, sf, dense: bool = False, smooth: bool = True) -> DataFrame:
    return W.build_features(event_panel(spark, sf), CFG, dense=dense, smooth=smooth)


def features_of(f: DataFrame) -> list[str]:
    """All features of the event panel, without the row number and the numbers that the vitals are made from."""
    return [n for n in W.feature_names(f) if n not in ("event_id", "k", "pulse")]


def learning_frame(spark, sf) -> DataFrame:
    """The columns learners read, written once: every fit scans this instead of rebuilding the features."""
    cols = [*ROW, "ts", "split", "patient_split", "days_since_last", "sbp", *dict.fromkeys([*SMALL, *LAGS]), "y_sbp_h0", "y_sbp_h1"]
    return pin(frame(spark, sf).select(*cols))


def fit_rows(f: DataFrame) -> DataFrame:
    return f.where("split = 'train' AND patient_split = 'fit'")


# ---- closed forms -------------------------------------------------------------------------------------

@query("backtest", sql(SQL_ALL_BASE, f"""
SELECT model, CAST(h + 1 AS INTEGER) AS steps_ahead, count(*) AS n, {sr('avg(abs(y - p))')} AS mae,
  {sr('avg(CASE WHEN abs(y - p) <= 10 THEN 1 ELSE 0 END)')} AS within_10
FROM fa WHERE step >= 7 AND y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2"""))
def backtest(spark, sf) -> DataFrame:
    b = B.backtest(baseline_forecasts(spark, sf), ["model"], 7)
    return b.select("model", "steps_ahead", "n", r("mae").alias("mae"), r("within_10").alias("within_10"))


@query("series_backtest", sql(SQL_BASE, f"""
SELECT series_id, CAST(h + 1 AS INTEGER) AS steps_ahead, count(*) AS n, {sr('avg(abs(y - p))')} AS mae
FROM fc WHERE model = 'personal_mean' AND step >= 7 AND y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2"""))
def series_backtest(spark, sf) -> DataFrame:
    b = B.backtest(baseline_forecasts(spark, sf).where("model = 'personal_mean'"), ["series_id"], 7)
    return b.select("series_id", "steps_ahead", "n", r("mae").alias("mae"))


SQL_BAND = SQL_BASE + """,
rs AS (SELECT h, split, y - p AS e FROM fc WHERE model = 'personal_mean' AND y IS NOT NULL AND p IS NOT NULL),
eg AS (SELECT h, quantile_cont(e, CAST(0.1 AS DOUBLE)) AS lo_e, quantile_cont(e, CAST(0.9 AS DOUBLE)) AS hi_e FROM rs WHERE split = 'train' GROUP BY 1),
cf AS (SELECT rs.h, quantile_cont(greatest(lo_e - e, e - hi_e), 0.8) AS widen FROM rs JOIN eg ON rs.h = eg.h WHERE split = 'val' GROUP BY 1)"""


@query("conformal_band", sql(SQL_BAND, f"""
SELECT CAST(eg.h AS INTEGER) AS h, {sr('lo_e - widen')} AS lo, {sr('hi_e + widen')} AS hi, {sr('widen')} AS widen FROM eg JOIN cf ON eg.h = cf.h"""))
def conformal_band(spark, sf) -> DataFrame:
    long = baseline_forecasts(spark, sf).where("model = 'personal_mean'")
    b = B.conformal_band(long, ["h"], event_rows(spark, sf))
    return b.select("h", *[r(c).alias(c) for c in ("lo", "hi", "widen")])


@query("band_coverage", sql(SQL_BAND, f"""
SELECT CAST(rs.h AS INTEGER) AS h, count(*) AS n, {sr('avg(CASE WHEN e BETWEEN lo_e - widen AND hi_e + widen THEN 1 ELSE 0 END)')} AS cover80
FROM rs JOIN eg ON rs.h = eg.h JOIN cf ON rs.h = cf.h WHERE split = 'test' GROUP BY 1"""))
def band_coverage(spark, sf) -> DataFrame:
    long = baseline_forecasts(spark, sf).where("model = 'personal_mean'")
    band = B.conformal_band(long, ["h"], event_rows(spark, sf))
    # One band per horizon.
    t = long.where("split = 'test'").join(F.broadcast(band), "h").withColumn("lo", F.col("p") + F.col("lo")).withColumn(
        "hi", F.col("p") + F.col("hi"))
    return M.evaluate(t, ["h"], lo="lo", hi="hi").select("h", "n", r("cover80").alias("cover80"))


def forecast_pairs(spark, sf) -> DataFrame:
    """Crossed baselines of the two vitals, which now and then contradict each other."""
    lanes = event_panel(spark, sf)
    ref = A.pressure_reference(lanes.done(lanes.df), bound=event_rows(spark, sf)).select("pp_abs_dev_p99")
    f = W.build_features(lanes, CFG)
    pairs = f.select("series_id", "event_id", "split", (F.col("sbp_lag1") - 20).alias("sbp_hat"), F.col("dbp_mean7").alias("dbp_hat"),
                     F.col("pp_mean7").alias("pp_ref"))
    return attach_row(pairs, ref).withColumn("codes", B.pair_codes("sbp_hat", "dbp_hat"))


SQL_PAIRS = SQL_EVENT_PANEL + "," + over_step(f"""
pr0 AS (SELECT series_id, event_id, split, {sql_lag('sbp', 1)} - 20 AS s, {sql_roll('avg', 'dbp', 7, 2)} AS d,
  {sql_roll('avg', '(sbp - dbp)', 7, 3)} AS ref FROM ep),
md AS (SELECT quantile_cont(sbp - dbp, 0.5) AS m FROM ep), tl AS (SELECT quantile_cont(abs(sbp - dbp - m), 0.99) AS tol FROM ep, md),
pr AS (SELECT *, s IS NULL OR d IS NULL AS missing, s - d <= 0 AS inv, s - d > 0 AND s - d < 10 AS low,
  s NOT BETWEEN 60 AND 260 AS so, d NOT BETWEEN 30 AND 160 AS dor, coalesce(abs(s - d - ref) > tol, false) AS far FROM pr0, tl)""")


@query("pair_coherence", sql(SQL_PAIRS, f"""
SELECT split, count(*) AS n, CAST(count(*) FILTER (WHERE missing OR inv OR low OR so OR dor OR far) AS BIGINT) AS n_violations,
  CAST(count(*) FILTER (WHERE inv) AS BIGINT) AS n_inverted, CAST(count(*) FILTER (WHERE low) AS BIGINT) AS n_below_floor,
  {sr('min(s - d)')} AS pp_min, {sr('max(s - d)')} AS pp_max FROM pr GROUP BY 1"""))
def pair_coherence(spark, sf) -> DataFrame:
    p = B.pair_report(forecast_pairs(spark, sf), ["split"], "codes", "sbp_hat", "dbp_hat")
    return p.select("split", "n", "n_violations", "n_inverted", "n_below_floor", r("pp_min").alias("pp_min"), r("pp_max").alias("pp_max"))


@query("pair_reasons", sql(SQL_PAIRS, """
SELECT code, count(*) AS n FROM (SELECT unnest(CASE WHEN missing THEN ['leg_missing'] ELSE list_filter([CASE WHEN inv THEN 'inverted' END,
  CASE WHEN low THEN 'below_pp_floor' END, CASE WHEN so THEN 'sbp_out_of_range' END, CASE WHEN dor THEN 'dbp_out_of_range' END,
  CASE WHEN far THEN 'pp_far_from_baseline' END], lambda x: x IS NOT NULL) END) AS code FROM pr) GROUP BY 1"""))
def pair_reasons(spark, sf) -> DataFrame:
    return B.pair_reasons(forecast_pairs(spark, sf))


# ---- smoothers and per-series models --------------------------------------------------------------------

def states(spark, sf, configs) -> DataFrame:
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df).select("series_id", "ts", "event_id", "sbp")
    return B.holt_states(rows, "series_id", ["ts", "event_id"], "sbp", configs, event_bound(spark, sf))


@query("damped_trend", sql("RECURSIVE " + (SQL_EVENT_PANEL + """,
f AS (SELECT series_id, max(CASE WHEN step = 0 THEN sbp END) AS v0, max(CASE WHEN step = 1 THEN sbp END) AS v1 FROM ep GROUP BY 1),
s AS (SELECT series_id, CAST(0 AS BIGINT) AS step, v0 AS lev, v1 - v0 AS tr FROM f
  UNION ALL SELECT s.series_id, e.step, 0.3 * e.sbp + 0.7 * (lev + 0.9 * tr),
    0.05 * (0.3 * e.sbp + 0.7 * (lev + 0.9 * tr) - lev) + 0.95 * 0.9 * tr
  FROM s JOIN ep e ON s.series_id = e.series_id AND e.step = s.step + 1),
o AS (SELECT e.series_id, e.step, CASE WHEN e.step = 0 THEN NULL WHEN e.step <= 2 THEN l.sbp ELSE s.lev + s.tr * CAST(0.9 AS DOUBLE) END AS p
  FROM ep e LEFT JOIN s ON s.series_id = e.series_id AND s.step = e.step - 1
  LEFT JOIN ep l ON l.series_id = e.series_id AND l.step = e.step - 1)""").strip(), f"SELECT series_id, step, {sr('p')} AS holt FROM o"))
def damped_trend(spark, sf) -> DataFrame:
    s = states(spark, sf, [(0.3, 0.05, 0.9)])
    p = F.when(F.col("step") > 0, B.holt_forecast(s, 0, 0.9, 1))
    return s.select("series_id", "step", r(p).alias("holt"))


@query("theta", sql("RECURSIVE " + (SQL_EVENT_PANEL + """,
s AS (SELECT series_id, step, sbp AS lev, sbp AS f FROM ep WHERE step = 0
  UNION ALL SELECT s.series_id, e.step, 0.3 * e.sbp + 0.7 * lev, f FROM s JOIN ep e ON s.series_id = e.series_id AND e.step = s.step + 1),
o AS (SELECT e.series_id, e.step, CASE WHEN e.step = 0 THEN NULL WHEN e.step <= 2 THEN l.sbp
    ELSE s.lev + 0.5 * (l.sbp - s.f) / (e.step - 1) END AS p
  FROM ep e LEFT JOIN s ON s.series_id = e.series_id AND s.step = e.step - 1
  LEFT JOIN ep l ON l.series_id = e.series_id AND l.step = e.step - 1)""").strip(), f"SELECT series_id, step, {sr('p')} AS theta FROM o"))
def theta(spark, sf) -> DataFrame:
    return B.theta_forecasts(states(spark, sf, [B.SES]), "series_id", 1, bound=event_bound(spark, sf)).select("series_id", "step", r("theta").alias("theta"))


@query("damped_trend_grid")
def damped_trend_grid(spark, sf) -> DataFrame:
    """Eighteen settings scored at once: one pass over each series keeps all states."""
    return B.holt_grid(states(spark, sf, B.HOLT_GRID), "series_id", 0)


@query("series_regression")
def series_regression(spark, sf) -> DataFrame:
    """Least squares on the series' own lags from sums; persistence where a series is too thin."""
    f = frame(spark, sf)
    lags = LAGS[:3]
    coef = B.solve_series(B.series_gram(f.where("split = 'train'"), "series_id", lags, "y_sbp_h0"), "series_id", 3, 20)
    p = B.apply_series(f.where("split = 'test'"), coef, "series_id", lags, F.col("sbp_lag1"), "p", event_bound(spark, sf))
    return p.select("series_id", "step", "p", F.col("y_sbp_h0").alias("y"))


SQL_SLOPE = SQL_EVENT_PANEL + "," + over_step(f"""
x AS (SELECT series_id, step, split, sbp AS y, {sql_lag('sbp', 1)} AS l FROM ep),
c AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE split = 'train' AND l IS NOT NULL GROUP BY 1 HAVING count(*) >= 30)""")


@query("series_autoregression", sql(SQL_SLOPE, f"""
SELECT x.series_id, step, {sr('coalesce(a + b * l, l)', 4)} AS p FROM x LEFT JOIN c ON x.series_id = c.series_id WHERE split = 'test'"""))
def series_autoregression(spark, sf) -> DataFrame:
    f = frame(spark, sf)
    coef = B.solve_series(B.series_gram(f.where("split = 'train'"), "series_id", ["sbp_lag1"], "y_sbp_h0"), "series_id", 1, 30)
    p = B.apply_series(f.where("split = 'test'"), coef, "series_id", ["sbp_lag1"], F.col("sbp_lag1"), "p", event_bound(spark, sf))
    return p.select("series_id", "step", r("p", 4).alias("p"))


@query("series_ridge")
def series_ridge(spark, sf) -> DataFrame:
    """Per-series ridge on the change from the last value; a pooled mean change where a series is thin."""
    f = frame(spark, sf).withColumn("_change", F.col("y_sbp_h0") - F.col("sbp_lag1"))
    cols = ["sbp_lag1", "sbp_mean7", "sbp_base_mean"]
    coef = B.solve_series(B.series_gram(f.where("split = 'train'"), "series_id", cols, "_change"), "series_id", 3, 30, ridge=1.0)
    p = B.apply_series(f.where("split = 'test'"), coef, "series_id", cols, F.lit(0.0), "change", event_bound(spark, sf))
    return p.select("series_id", "step", (F.col("sbp_lag1") + F.col("change")).alias("p"), F.col("y_sbp_h0").alias("y"))


SQL_LEGS = SQL_EVENT_PANEL + "," + over_step(f"""
lg AS (SELECT series_id, event_id, step, {sql_lag('sbp', 1)} AS a, {sql_expand('avg', 'sbp')} AS b, {sql_roll('avg', 'sbp', 3, 2)} AS c FROM ep)""")


@query("ensemble_means", sql(SQL_LEGS, f"""
SELECT series_id, event_id, {sr('list_avg(list_filter([a, b, c], lambda x: x IS NOT NULL))')} AS ens_mean,
  {sr('list_median(list_filter([a, b, c], lambda x: x IS NOT NULL))')} AS ens_median FROM lg"""))
def ensemble_means(spark, sf) -> DataFrame:
    f = frame(spark, sf).select("series_id", "event_id", F.col("sbp_lag1").alias("a"), F.col("sbp_base_mean").alias("b"),
                                F.col("sbp_mean3").alias("c"))
    return f.select("series_id", "event_id", r(B.ensemble(["a", "b", "c"], "mean")).alias("ens_mean"),
                    r(B.ensemble(["a", "b", "c"], "median")).alias("ens_median"))


@query("ensemble_weighted")
def ensemble_weighted(spark, sf) -> DataFrame:
    """Ridge, boosting and a smoother in four ensembles, per horizon and arm; weights from the inner tail of train rows."""
    f = frame(spark, sf, dense=True, smooth=False)                  # a tree may split otherwise for a last bit
    f = pin(f.select("series_id", "step", "ts", "event_id", "split", "patient_split", *[f"y_sbp_h{h}" for h in CFG.horizons],
                     *[c for c in features_of(f) if c not in ("series_id", "step")]))         # every horizon reads it
    s = pin(states(spark, sf, B.HOLT_GRID).select("series_id", "step", "_v", "level", "trend"))
    learn = f.where("split = 'train' AND patient_split = 'fit'").select("series_id", "step")
    out = None
    for h in CFG.horizons:
        best = B.holt_grid(s.join(learn, ["series_id", "step"], "left_semi"), "series_id", h).orderBy("mae", "config").first()["config"]
        p = F.when(F.col("step") > 0, B.holt_forecast(s, best, B.HOLT_GRID[best][2], h + 1)).alias("holt")
        rows, weights = K.ensembles(f.join(s.select("series_id", "step", p), ["series_id", "step"], "left"), features_of(f), f"y_sbp_h{h}",
                                    ["ts", "event_id"], "holt", bound=event_rows(spark, sf), lane_bound=event_bound(spark, sf))
        names = [*K.TABULAR, "holt", "ens_mean", "ens_median", "ens_inv_mae", "ens_stack"]
        long = W.unpivot(rows, names, "model", "p", ["arm", F.col(f"y_sbp_h{h}").cast("double").alias("y")])
        found = F.create_map(*[x for n, w in weights.items() if w for x in (F.lit(n), F.array(*[F.lit(v) for v in w]))]) if any(weights.values()) else None
        board = M.evaluate(long, ["model", "arm"]).withColumn("h", F.lit(h)).withColumn(
            "weights", F.try_element_at(found, F.col("model")) if found is not None else F.lit(None).cast("array<double>"))
        out = board if out is None else out.unionByName(board)
    return out


# ---- decisions ------------------------------------------------------------------------------------------

@query("model_win_rates", sql(SQL_ALL_BASE + """,
er AS (SELECT series_id, model, avg(abs(y - p)) AS e FROM fa WHERE split = 'test' AND h = 0 AND y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)""", f"""
SELECT a.model, {sr('avg(CASE WHEN a.e < b.e THEN 1 ELSE 0 END)')} AS win_rate FROM er a JOIN er b ON a.series_id = b.series_id AND b.model = 'personal_mean' GROUP BY 1"""))
def model_win_rates(spark, sf) -> DataFrame:
    f = baseline_forecasts(spark, sf).where("split = 'test' AND h = 0 AND y IS NOT NULL AND p IS NOT NULL")
    w = B.win_rates(f.withColumn("e", F.abs(F.col("y") - F.col("p"))), "series_id", "personal_mean")
    return w.select("model", r("win_rate").alias("win_rate"))


SQL_TIES = SQL_ALL_BASE + """,
er AS (SELECT series_id, event_id, model, abs(y - p) AS e FROM fa WHERE split = 'test' AND h = 0 AND y IS NOT NULL AND p IS NOT NULL),
pe AS (SELECT a.model, a.event_id, a.e - b.e AS d FROM er a JOIN er b ON a.event_id = b.event_id AND b.model = 'personal_mean'),""" + sql_resampled(
    "pe", "model", "d", "event_id") + """,
se AS (SELECT series_id, model, avg(e) AS e FROM er GROUP BY 1, 2),
wr AS (SELECT a.model, avg(CASE WHEN a.e < b.e THEN 1 ELSE 0 END) AS win_rate FROM se a JOIN se b ON a.series_id = b.series_id AND b.model = 'personal_mean' GROUP BY 1),
ti AS (SELECT rs.*, win_rate, (lo <= 0 AND hi >= 0) OR rs.model = 'personal_mean' AS ties_leader FROM rs JOIN wr ON rs.model = wr.model WHERE n >= 30)"""


@query("tie_set", sql(SQL_TIES, f"""
SELECT model, n, {sr('mean')} AS delta, {sr('lo')} AS lo, {sr('hi')} AS hi, {sr('win_rate')} AS win_rate, ties_leader FROM ti"""))
def tie_set(spark, sf) -> DataFrame:
    f = baseline_forecasts(spark, sf).where("split = 'test' AND h = 0")
    t = B.tie_set(f, "personal_mean", ["event_id"], "series_id")
    return t.select("model", "n", *[r(c).alias(c) for c in ("delta", "lo", "hi", "win_rate")], "ties_leader")


@query("shipped_model", sql(SQL_TIES + """,
va AS (SELECT model, avg(abs(y - p)) AS mae FROM fa WHERE split = 'val' AND h = 0 AND y IS NOT NULL AND p IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)""", f"""
SELECT ti.model, {sr('mae')} AS mae, {sr('win_rate')} AS win_rate, CAST(cost AS INTEGER) AS cost FROM ti JOIN va ON ti.model = va.model
JOIN (SELECT unnest({list(B.BASELINES)}) AS model, unnest(range({len(B.BASELINES)})) AS cost) c ON c.model = ti.model WHERE ties_leader
ORDER BY cost, mae, ti.model LIMIT 1"""))
def shipped_model(spark, sf) -> DataFrame:
    f = pin(baseline_forecasts(spark, sf).where("h = 0 AND split IN ('val', 'test')").select("split", "model", "event_id", "series_id", "y", "p"))
    val = M.evaluate(f.where("split = 'val'"), ["model"]).select("model", "mae")
    ties = B.tie_set(f.where("split = 'test'"), "personal_mean", ["event_id"], "series_id")
    best = B.cheapest_tied(ties, val, {m: i for i, m in enumerate(B.BASELINES)})
    return best.select("model", r("mae").alias("mae"), r("win_rate").alias("win_rate"), "cost")


# ---- learned models ---------------------------------------------------------------------------------------

KINDS = ["ridge", "ridge_delta", "ridge_window", "ridge_window_delta", "ridge_own", "elastic_net", "huber", "gbt", "forest"]


@query("model_sweep")
def model_sweep(spark, sf) -> DataFrame:
    """All baselines and learners over every feature, both signals, all horizons and arms; failed fits are rows with a note."""
    f = frame(spark, sf, dense=True, smooth=False)                  # a tree may split otherwise for a last bit
    long, notes = L.sweep(f, features_of(f), CFG.signals, CFG.horizons, KINDS, bound=event_rows(spark, sf))
    board = M.evaluate(long, ["signal", "h", "model", "family", "arm"], last="last", least=L.MIN_TEST)
    return board.unionByName(notes.withColumn("family", F.lit("learned")).withColumn("arm", F.lit("all")), allowMissingColumns=True)


@query("residual_intercepts")
def residual_intercepts(spark, sf) -> DataFrame:
    f = learning_frame(spark, sf)
    p = L.residual_intercepts(fit_rows(f), f.where("split = 'test'"), "ridge", SMALL, "y_sbp_h0", bound=event_bound(spark, sf))
    return M.evaluate(p.select("patient_split", F.col("y_sbp_h0").alias("y"), "p"), ["patient_split"])


@query("parameter_search")
def parameter_search(spark, sf) -> DataFrame:
    """Expanding folds inside every series; a setting must beat the default to be kept."""
    f = learning_frame(spark, sf).where("split = 'train'")
    again = lay_out(f.drop("step"), ["series_id"], ["ts", "event_id"], bound=event_bound(spark, sf))
    ranked = again.done(P.percent_rank(again, again.df))
    grid = [{"regParam": 0.1}, {"regParam": 1.0}, {"regParam": 10.0}]
    return L.search(pin(P.folds(ranked, 2)), "ridge", SMALL, "y_sbp_h0", grid, 2)


@query("tuning_comparison")
def tuning_comparison(spark, sf) -> DataFrame:
    f = learning_frame(spark, sf)
    def scored(**params):
        p = L.fit_predict(fit_rows(f), f.where("split = 'val'"), "ridge", SMALL, "y_sbp_h0", **params)
        e = p.select("event_id", F.lit("sbp").alias("signal"), F.lit("ridge").alias("model"), F.abs(F.col("y_sbp_h0") - F.col("p")).alias("e"))
        return M.resampled_mean(e, ["signal", "model"], "e", ["event_id"], draws=50).withColumnRenamed("mean", "mae")
    return B.tuning_comparison(scored(), scored(regParam=5.0))


@query("champion_challenger")
def champion_challenger(spark, sf) -> DataFrame:
    """Two models on identical rows, with the paired difference."""
    f = learning_frame(spark, sf)
    test = f.where("split = 'test' AND y_sbp_h0 IS NOT NULL").select("event_id", "y_sbp_h0", *SMALL)
    both = L.fit_predict(fit_rows(f), test, "ridge", SMALL, "y_sbp_h0", name="champion")
    both = L.fit_predict(fit_rows(f), both, "gbt", SMALL, "y_sbp_h0", name="challenger")
    e = both.withColumn("e1", F.abs(F.col("champion") - F.col("y_sbp_h0"))).withColumn("e2", F.abs(F.col("challenger") - F.col("y_sbp_h0")))
    d = M.paired(e.withColumn("_all", F.lit("sbp")), ["_all"], "e2", "e1", ["event_id"])
    return d.withColumnRenamed("_all", "signal").withColumn("challenger_wins", F.col("hi") < 0)


@query("block_importance")
def block_importance(spark, sf) -> DataFrame:
    """Every kept feature with all members of its cluster, permuted together three times, for the ridge on the kept features."""
    f = pin(frame(spark, sf, dense=True))
    names, audit, _ = X.select_features(f, features_of(f), ["y_sbp_h0", "y_sbp_h1", "y_sbp_h2"])
    blocks = {x["feature"]: [m for m in x["members"] if m in set(names)] for x in X.cluster_blocks(audit).orderBy("feature").collect()}    # one row a feature
    train = fit_rows(f).where(F.col("y_sbp_h1").isNotNull())
    label = {"y": F.col("y_sbp_h1")}
    cells = G.pack(train, names, label)
    centre = G.medians(train, names, event_rows(spark, sf), cells)
    model = G.ridge(G.sums(train, names, centre, label, cells=cells)["y"], np.arange(len(names)))
    score = lambda rows: G.predict(rows, names, centre, [model], ["block", "repeat", "y_sbp_h1"], "_p").withColumn("p", F.col("_p")[0])
    return L.block_importance(score, f.where("split = 'test'"), names, "y_sbp_h1", blocks)


@query("prediction_explanations")
def prediction_explanations(spark, sf) -> DataFrame:
    f = learning_frame(spark, sf)
    train = L.doubles(fit_rows(f), SMALL).withColumn("_label", F.col("y_sbp_h0"))
    model = L.make_model("ridge", SMALL).fit(train.select(*SMALL, "_label"))
    med = quantiles(W.unpivot(train, SMALL), ["feature"], "value", {"m": 0.5}, 13 * event_rows(spark, sf))
    reference = {x["feature"]: x["m"] for x in med.collect()}           # one number per feature
    newest = f.groupBy("series_id").agg(F.max_by(F.struct(*SMALL), "step").alias("l")).select("series_id", "l.*")
    return L.explain(model, newest, SMALL, reference, "series_id")


@query("shuffled_target_probe")
def shuffled_target_probe(spark, sf) -> DataFrame:
    """A model fitted on dealt-out targets must not beat persistence."""
    from seriesloom.operators.leakage import shuffled_target
    f = learning_frame(spark, sf)
    train = shuffled_target(f.where("split = 'train' AND y_sbp_h0 IS NOT NULL"), "y_sbp_h0", ["series_id", "event_id"])
    test = f.where("split = 'test' AND sbp_lag1 IS NOT NULL AND y_sbp_h0 IS NOT NULL")
    p = L.fit_predict(train, test, "ridge", SMALL, "y_shuffled")
    y = F.col("y_sbp_h0")
    return p.agg(F.avg(F.abs(y - F.col("p"))).alias("mae_shuffled"), F.avg(F.abs(y - F.col("sbp_lag1"))).alias("mae_persistence"))


def selected(spark, sf):
    """Selection over every feature and every target, Pearson and Spearman."""
    f = frame(spark, sf, dense=True)
    return X.select_features(f, features_of(f), [f"y_{s}_h{h}" for s in CFG.signals for h in CFG.horizons])


@query("feature_selection")
def feature_selection(spark, sf) -> DataFrame:
    """Audit of kept and dropped features with relevance, cluster and density."""
    return selected(spark, sf)[1]


@query("selection_blocks")
def selection_blocks(spark, sf) -> DataFrame:
    return X.cluster_blocks(selected(spark, sf)[1])


def thinned_features(spark, sf, dense: bool = False) -> DataFrame:
    """Every series thinned by five fractions, features rebuilt for all at once."""
    lanes = event_panel(spark, sf)
    lanes.df = lanes.df.select("series_id", "ts", "event_id", "step", "sbp", "dbp", "split", "days_since_last")
    thinned = P.thin(lanes, CFG.thin_fracs, 42, ["ts", "event_id"]).drop("step", "old_step")
    again = lay_out(thinned, ["series_id", "drop_frac"], ["ts", "event_id"], reach=W.REACH, bound=event_bound(spark, sf))
    return W.build_features(again, CFG, dense=dense)


@query("missingness_sweep")
def missingness_sweep(spark, sf) -> DataFrame:
    """The ridge refitted and scored on every thinned copy."""
    f = thinned_features(spark, sf, dense=True)
    return L.missingness(f, [n for n in features_of(f) if n != "drop_frac"], "y_sbp_h0", CFG.thin_fracs, 5 * event_rows(spark, sf))


@query("missingness_sizes", sql(SQL_EVENT_PANEL, f"""
SELECT drop_frac, count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test FROM (
  SELECT f AS drop_frac, split, n, CASE WHEN n <= 3 THEN 0 ELSE CAST(round_even(f * (n - 2), 0) AS BIGINT) END AS n_drop,
    CASE WHEN inside THEN row_number() OVER (PARTITION BY f, series_id, inside ORDER BY md5(concat(series_id, ':', step, ':42')), step) - 1 END AS rank
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, step > 0 AND step < count(*) OVER (PARTITION BY series_id) - 1 AS inside FROM ep),
    (SELECT unnest({list(CFG.thin_fracs)})::DOUBLE AS f))
WHERE rank IS NULL OR rank >= n_drop GROUP BY 1"""))
def missingness_sizes(spark, sf) -> DataFrame:
    """Train and test rows that thinning leaves for the refits."""
    return L.thinned_sizes(thinned_features(spark, sf), "y_sbp_h0").select("drop_frac", "n_rows", "n_train", "n_test")


@query("walk_forward_parity", sql(SQL_EVENT_PANEL + "," + over_step(f"""
f AS (SELECT series_id, step, sbp, {sql_roll('avg', 'sbp', 7, 2)} AS m7, count(*) OVER (PARTITION BY series_id) AS n FROM ep),
c AS (SELECT f.*, CAST(floor(CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) + i * ((n - 2) - CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)) / CAST(3 AS DOUBLE)) AS BIGINT) AS cut
  FROM f, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE n >= 25)"""), f"""
SELECT count(*) AS n, {sr('avg(abs(m7 - sbp))')} AS serve_mae FROM c WHERE step = cut"""))
def walk_forward_parity(spark, sf) -> DataFrame:
    """Truncate every series at four late cuts, rebuild features from the truncated history only, compare."""
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.whole(lanes.df, n=F.count("*"))).where("n >= 25").select(
        "series_id", "ts", "event_id", "step", "sbp", "dbp", "n")
    lo = F.floor(F.col("n") * F.lit(0.7))
    cuts = F.explode(F.array(*[F.floor(lo + F.lit(i) * ((F.col("n") - 2) - lo) / 3.0) for i in range(4)]))
    each = rows.withColumn("cut", cuts).where(F.col("step") <= F.col("cut"))
    truth = each.where("step = cut").select("series_id", "cut", F.col("sbp").alias("actual"))
    hidden = each.withColumn("sbp", F.when(F.col("step") < F.col("cut"), F.col("sbp"))).withColumn(
        "dbp", F.when(F.col("step") < F.col("cut"), F.col("dbp"))).withColumnRenamed("step", "_step")
    again = lay_out(hidden, ["series_id", "cut"], ["ts", "event_id", "_step"], reach=W.REACH, bound=event_bound(spark, sf))
    served = W.build_features(again, CFG).where("_step = cut").select("series_id", "cut", "sbp_mean7")
    return served.join(truth, ["series_id", "cut"]).agg(
        F.count("*").alias("n"), r(F.avg(F.abs(F.col("sbp_mean7") - F.col("actual")))).alias("serve_mae"))


@query("cold_start_curve", sql(SQL_PRIOR + f""",
cb AS (SELECT series_id, np, count(*) AS n, quantile_cont(sbp, 0.9) AS personal, stddev_samp(sbp) AS sd, min(cohort_key) AS cohort_key
  FROM ep, (SELECT unnest({list(CFG.cold_probe)}) AS np) WHERE step < np GROUP BY 1, 2 HAVING count(*) = np),
ct AS (SELECT np, sd, CASE WHEN n < {CFG.cold_start_min} THEN 'cold_start' WHEN n < {CFG.steady_state} THEN 'bootstrapping' ELSE 'steady' END AS tier,
  140 + least(greatest(CASE WHEN n >= 5 THEN n / (n + CAST(30 AS DOUBLE)) * personal + (1 - n / (n + CAST(30 AS DOUBLE))) * coalesce(cohort, g)
    ELSE coalesce(cohort, g) END - 140, -25), 15) AS t
  FROM cb CROSS JOIN gp LEFT JOIN pr ON cb.cohort_key = pr.cohort_key)""", f"""
SELECT CAST(np AS INTEGER) AS n_readings, tier, count(*) AS n_series, {sr('avg(t)')} AS threshold, {sr('avg(2.5631 * sd)')} AS band_width FROM ct GROUP BY 1, 2"""))
def cold_start_curve(spark, sf) -> DataFrame:
    """What a series gets after its first n rows: confidence tier, threshold, width of the recent band."""
    from seriesloom.operators.serving import confidence_tier
    lanes = event_panel(spark, sf)
    panel = lanes.done(lanes.df)
    c, g = O.priors(O.warm_rows(panel, [CFG.warm]), [0.9], event_rows(spark, sf))
    probes = F.explode(F.array(*[F.lit(n) for n in CFG.cold_probe]))
    each = panel.where(F.col("step") < max(CFG.cold_probe)).withColumn("n_readings", probes).where(F.col("step") < F.col("n_readings"))
    per = each.groupBy("series_id", "n_readings").agg(
        F.count("*").alias("n"), F.percentile("sbp", F.lit(0.9)).alias("personal"), F.stddev_samp("sbp").alias("sd"),
        F.min("age").alias("age"), F.min("is_male").alias("is_male")).where("n = n_readings")
    from seriesloom.functions.expr import cohort_key
    j = attach_row(per.withColumn("cohort_key", cohort_key("age", "is_male")).join(F.broadcast(c.drop("warm")), "cohort_key", "left"), g.drop("warm"))
    j = j.withColumn("cohort_q900", F.coalesce("cohort_q900", "global_q900"))
    j = j.withColumn("threshold", O.cap(O.blend("n", "personal", "cohort_q900", CFG.shrink_k), CFG)).withColumn("tier", confidence_tier("n", CFG))
    return j.groupBy("n_readings", "tier").agg(F.count("*").alias("n_series"), r(F.avg("threshold")).alias("threshold"),
                                               r(F.avg(2.5631 * F.col("sd"))).alias("band_width"))


@query("learned_thresholds")
def learned_thresholds(spark, sf) -> DataFrame:
    """Mean-native learners shifted by the 0.90 quantile of calibration residuals, on one board with the references."""
    f = pin(cut_frame(spark, sf))
    cols = [c for c in O.HISTORY]
    train, n = f.where("offset_split = 'train'"), event_rows(spark, sf)
    scored = f
    names = {}
    for kind in ("ridge", "elastic_net", "huber", "forest"):
        scored = L.fit_predict(train, scored, kind, cols, "y", name=f"_m_{kind}")
        names[kind] = f"_m_{kind}"
    calib = scored.where("offset_split = 'calib'")
    resid = W.unpivot(calib.select(*[(F.col("y") - F.col(m)).alias(k) for k, m in names.items()]), list(names), "model", "e")
    shift = {x["model"]: x["s"] for x in quantiles(resid, ["model"], "e", {"s": CFG.quantile}, n).collect()}     # one per model
    scored = O.predict_bayes_blend(scored, O.fit_bayes_blend(train, n), "_m_blend")
    cands = {k: F.col(m) + shift[k] for k, m in names.items()} | {"empirical-Bayes blend": F.col("_m_blend")}
    refs = O.reference_candidates(CFG.shrink_k, CFG)
    long = O.long_candidates(scored, {**cands, **refs}, {k: "reference" for k in refs}, CFG)
    return O.board(long, CFG)


@query("threshold_promotion", sql(SQL_BLEND + """,
cp AS (SELECT 'blend' AS candidate, series_id, cut, y, 140 + least(greatest(pred - 140, -25), 15) AS p,
  140 + least(greatest(hist_n / (hist_n + CAST(30 AS DOUBLE)) * q90 + (1 - hist_n / (hist_n + CAST(30 AS DOUBLE))) * cohort_prior - 140, -25), 15) AS ref
  FROM bb WHERE part = 'holdout'),
er AS (SELECT candidate, series_id, cut, greatest(0.9 * (y - p), -0.1 * (y - p)) - greatest(0.9 * (y - ref), -0.1 * (y - ref)) AS d FROM cp),""" + sql_resampled(
    "er", "candidate", "d", "concat(series_id, ':', cut)"), f"""
SELECT candidate, n, {sr('mean')} AS delta, {sr('lo')} AS lo, {sr('hi')} AS hi, hi < 0 AS promoted FROM rs WHERE n >= 30"""))
def threshold_promotion(spark, sf) -> DataFrame:
    """The learned blend against the best reference on holdout entities, paired: promoted when the interval lies below zero."""
    f = cut_frame(spark, sf)
    scored = O.predict_bayes_blend(f, O.fit_bayes_blend(f.where("offset_split = 'train'"), event_rows(spark, sf)), "_m")
    ho = scored.where("offset_split = 'holdout'").withColumn("candidate", F.lit("blend"))
    y = F.col("y")
    ref = O.reference_candidates(CFG.shrink_k, CFG)["capped blend (reference)"]
    e = ho.select("candidate", "series_id", "cut", O.pinball(y, O.cap(F.col("_m"), CFG)).alias("a"), O.pinball(y, O.cap(ref, CFG)).alias("b"))
    d = M.paired(e, ["candidate"], "a", "b", ["series_id", "cut"])
    return d.select("candidate", "n", *[r(c).alias(c) for c in ("delta", "lo", "hi")], (F.col("hi") < 0).alias("promoted"))


# ---- learned detectors and heads ----------------------------------------------------------------------------

@query("learned_detectors")
def learned_detectors(spark, sf) -> DataFrame:
    """Subspace of 10, four diagonal components and covariance distance over all dense varying columns, ranked against the events."""
    f = detector_frame(spark, sf, dense=True)
    features = features_of(f.drop(*[c for c in f.columns if c.startswith(("d_", "event_"))]))
    f = pin(f.select("series_id", "split", "event_next", *features))
    shape = N.learn(f.where("split = 'train'"), N.matrix_columns(f, features), (4,), event_rows(spark, sf))
    rows = N.score(f, shape, ["event_next"], (10,))
    long = W.unpivot(rows, ["pca_10", "gmm_4", "covariance"], "detector", "score", ["event_next"])
    return M.ranking(long, ["detector"], "score", "event_next", event_rows(spark, sf))


@query("tuned_detectors")
def tuned_detectors(spark, sf) -> DataFrame:
    """Smoothing, CUSUM, Page-Hinkley, subspace and mixture grids, all scored on validation rows in one job."""
    lanes = event_panel(spark, sf)
    thr = D.event_thresholds(lanes.done(lanes.df), bound=event_bound(spark, sf))
    df = D.label_events(lanes, attach(lanes.df, thr, "series_id", bound=lanes.longest))
    df = df.withColumn("_x", F.lag("sbp").over(lanes.window))
    df = D.cusum(lanes, df, "_x", {"cusum_50": 0.5, "cusum_25": 0.25, "cusum_100": 1.0})
    df = D.page_hinkley(lanes, df, "_x", {"ph_05": 0.05, "ph_01": 0.01, "ph_20": 0.2})
    df = W.build_features(lanes, CFG, df, dense=True, smooth=False)                # mixtures start at rows of least hash
    features = features_of(df.drop("_x", "event_threshold", *[c for c in df.columns if c.startswith(("event_", "cusum_", "ph_"))]))
    more = (0.05, 0.2, 0.4)
    again = lay_out(df.drop("step"), ["series_id"], ["ts", "event_id"], reach=W.REACH, bound=event_bound(spark, sf))
    df = W.add_ewma(again, again.df, {"sbp": F.col("sbp")}, more)
    gaps = [(F.abs(F.col("_x") - F.col(W.ewm_name("sbp", a))) / F.nullif(F.col("sbp_base_std"), F.lit(0.0)))
            .alias(f"gap_{int(a * 100):02d}") for a in (0.1, *more)]
    running = ["cusum_50", "cusum_25", "cusum_100", "ph_05", "ph_01", "ph_20"]
    rows = pin(again.done(df).select("series_id", "split", "event_next", *running, *gaps, *features))
    shape = N.learn(rows.where("split = 'train'"), N.matrix_columns(rows, features), (4, 2, 8), event_rows(spark, sf))
    kept = ["split", "event_next", *running, "gap_10", "gap_05", "gap_20", "gap_40"]
    scored = N.score(rows.where("split = 'val'"), shape, kept, (10, 5, 20), covariance=False)
    families = {"statistical": ("gap_10", ["gap_05", "gap_20", "gap_40"]), "cusum": ("cusum_50", ["cusum_25", "cusum_100"]),
                "page_hinkley": ("ph_05", ["ph_01", "ph_20"]), "subspace": ("pca_10", ["pca_5", "pca_20"]), "mixture": ("gmm_4", ["gmm_2", "gmm_8"])}
    lifts = D.ap_lifts(scored, [c for d, cs in families.values() for c in (d, *cs)], event_rows(spark, sf))
    return D.pick_tuned(lifts, families)


@query("tier_classifier")
def tier_classifier(spark, sf) -> DataFrame:
    """Multi-class head on the tier of the next row, confusion counts on the test tail."""
    from seriesloom.operators.rules import classifier_frame
    lanes, al = event_alerts(spark, sf)
    alerts = lanes.done(al).select("series_id", "step", "tier", "rule_id", "gate_reason")
    f = pin(classifier_frame(learning_frame(spark, sf), alerts, 1))
    model = L.tier_head(f, SMALL)
    if model is None:               # too little to learn from: the rows are counted without a prediction
        rest = f.where("split = 'test' AND trainable")
        return rest.groupBy("tier_label", F.lit(None).cast("string").alias("predicted")).agg(F.count("*").alias("n"))
    scored = model.transform(L.doubles(f.where("split = 'test' AND trainable"), SMALL))
    names = F.array(*[F.lit(x) for x in model.stages[0].labels] + [F.lit("unseen")])
    return scored.groupBy("tier_label", F.element_at(names, F.col("_pred").cast("int") + 1).alias("predicted")).agg(F.count("*").alias("n"))


SYMPTOMS = ["dizziness", "severe_headache", "edema", "palpitations", "sob", "syncope", "face_swelling", "dry_cough"]
#: Columns of the same row that a symptom's head must not read.
SAME_ROW = {*SYMPTOMS, "missed_3d", "adherence_7d"}


def symptom_heads(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Heads of every symptom zero to two rows ahead: scored rows of threshold pool and test split, and one row per head."""
    lanes = event_panel(spark, sf)
    at = {(s, h): f"_y_{s}_{h}" for s in SYMPTOMS for h in CFG.horizons}
    df = lanes.df.select("*", *[(F.lead(s, h).over(lanes.window) if h else F.col(s)).alias(c) for (s, h), c in at.items()])
    f = W.build_features(lanes, CFG, df, dense=True)
    names = [n for n in features_of(f) if n not in SAME_ROW and not n.startswith("_y_")]
    return R.rare_event_heads(f, names, at, ["series_id", "is_male", "is_dm", "segment"], bound=24 * event_rows(spark, sf))


@query("rare_event_head")
def rare_event_head(spark, sf) -> DataFrame:
    """Every symptom and horizon: calibrated, cut at the alert budget, scored on test rows, or why there is no head."""
    return R.board(*symptom_heads(spark, sf), 24 * event_rows(spark, sf))


@query("head_parity")
def head_parity(spark, sf) -> DataFrame:
    """Spread of the precision-recall area between subgroups, per head and axis."""
    long, _ = symptom_heads(spark, sf)
    out = None
    for axis in ("is_male", "is_dm", "segment"):
        one = R.parity(long, axis, bound=24 * event_rows(spark, sf)).withColumn("axis", F.lit(axis))
        out = one if out is None else out.unionByName(one)
    return out


@query("chained_scoring")
def chained_scoring(spark, sf) -> DataFrame:
    """Forecast rows appended at three quadrature nodes, features rebuilt, risk averaged over the nodes."""
    from seriesloom.operators.serving import chain_nodes, chained_risk
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df).select("series_id", "ts", "event_id", "sbp", "dbp")
    level = lanes.done(lanes.df.select("*", F.avg("sbp").over(lanes.rows(-6, 0)).alias("_l"), F.stddev_samp("sbp").over(lanes.rows(-6, 0)).alias("_s")))
    last = level.groupBy("series_id").agg(
        F.max_by(F.struct("ts", "event_id", "_l", "_s", "dbp"), "step").alias("l"), P.usual_gap().alias("median_gap")).select("series_id", "median_gap", "l.*")
    ahead = chain_nodes(last.select("series_id", "ts", "event_id", "median_gap", F.col("_l").alias("sbp_hat"), F.col("dbp").alias("dbp_hat"),
                                    (F.col("_l") - 1.2815515655446004 * F.col("_s")).alias("lo80"),
                                    (F.col("_l") + 1.2815515655446004 * F.col("_s")).alias("hi80")), 3)
    risk = lambda: 1 / (1 + F.exp(-(F.log(F.lit(0.03 / 0.97)) + 0.055 * F.greatest(F.col("sbp_lag1") - 140, F.lit(0.0)))))
    return chained_risk(rows, ahead, CFG, risk(), event_bound(spark, sf) + 3)
