"""Queries over causal features, targets, the feature dictionary and leakage audits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from seriesloom.config import Config
from seriesloom.functions.lanes import lay_out
from seriesloom.operators import features as W
from seriesloom.operators import panel as P
from seriesloom.plans.registry import query
from seriesloom.plans.roles import CONFIG, SQL_PANEL, event_bound, event_lanes, longest, panel, r, sql, sr, table


def feature_frame(spark, sf, config: Config = CONFIG) -> DataFrame:
    return W.build_features(panel(spark, sf, config), config)


def pick(df: DataFrame, columns) -> DataFrame:
    return df.select("series_id", "step", *[r(c).alias(c) for c in columns])


def frame(first: int, last: int) -> str:
    low = "UNBOUNDED PRECEDING" if first is None else f"{-first} PRECEDING"
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {low} AND {-last} PRECEDING)"


def sql_roll(fn: str, col: str, w: int, least: int) -> str:
    f = frame(-w, -1)
    return f"CASE WHEN count({col}) OVER {f} >= {least} THEN {fn}({col}) OVER {f} END"


def sql_expand(fn: str, col: str, least: int = 5) -> str:
    f = frame(None, -1)
    return f"CASE WHEN count({col}) OVER {f} >= {least} THEN {fn}({col}) OVER {f} END"


def sql_slope(col: str, w: int) -> str:
    f = frame(-w, -1)
    return f"CASE WHEN count({col}) OVER {f} = {w} THEN regr_slope({col}, step) OVER {f} END"


def sql_lag(col: str, k: int) -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY series_id ORDER BY ts)"


LAG_SQL = ", ".join(f"{sr(sql_lag('sbp', k))} AS sbp_lag{k}" for k in (1, 2, 3, 5, 7, 14))


@query("lag_features", sql(SQL_PANEL, f"SELECT series_id, step, {LAG_SQL}, "
                           f"{sr(sql_lag('sbp', 1) + ' - ' + sql_lag('sbp', 2))} AS sbp_d1 FROM pn"))
def lag_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), [*[f"sbp_lag{k}" for k in CONFIG.lags], "sbp_d1"])


ROLL_SQL = ", ".join(
    f"{sr(sql_roll(fn, 'sbp', w, max(2, w // 3)))} AS sbp_{n}{w}"
    for w in (3, 7, 14, 30) for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query("rolling_features", sql(SQL_PANEL, f"SELECT series_id, step, {ROLL_SQL}, " + ", ".join(
    f"{sr(sql_roll('max', 'sbp', w, max(2, w // 3)) + ' - ' + sql_roll('min', 'sbp', w, max(2, w // 3)))} AS sbp_range{w}"
    for w in (3, 7, 14, 30)) + " FROM pn"))
def rolling_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), [f"sbp_{n}{w}" for w in CONFIG.windows
                                           for n in ("mean", "std", "min", "max", "range")])


@query("slope_features", sql(SQL_PANEL, "SELECT series_id, step, " + ", ".join(
    f"{sr(sql_slope('sbp', w))} AS sbp_slope{w}" for w in (3, 7, 14)) + " FROM pn"))
def slope_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), [f"sbp_slope{w}" for w in (3, 7, 14)])


SQL_EWM = """
RECURSIVE {base},
u AS (SELECT series_id, step, lag({value}) OVER (PARTITION BY series_id ORDER BY step) AS x FROM {source}),
e AS (SELECT series_id, step, CAST(x AS DOUBLE) AS y1, CAST(x AS DOUBLE) AS y3, 1 AS gap FROM u WHERE step = 0
  UNION ALL SELECT u.series_id, u.step,
    CASE WHEN u.x IS NULL THEN e.y1 WHEN e.y1 IS NULL THEN u.x
         ELSE (pow(0.9, e.gap) * e.y1 + 0.1 * u.x) / (pow(0.9, e.gap) + 0.1) END,
    CASE WHEN u.x IS NULL THEN e.y3 WHEN e.y3 IS NULL THEN u.x
         ELSE (pow(0.7, e.gap) * e.y3 + 0.3 * u.x) / (pow(0.7, e.gap) + 0.3) END,
    CASE WHEN u.x IS NULL AND e.y1 IS NOT NULL THEN e.gap + 1 ELSE 1 END
  FROM e JOIN u ON e.series_id = u.series_id AND u.step = e.step + 1)"""


@query("smoothed_features", sql(SQL_EWM.format(base=SQL_PANEL.strip(), value="sbp", source="pn"),
                                f"SELECT series_id, step, {sr('y1')} AS sbp_ewm10, {sr('y3')} AS sbp_ewm30 FROM e"))
def smoothed_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), ["sbp_ewm10", "sbp_ewm30"])


SQL_HOLES = """
pn AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)"""


@query("smoothed_with_holes", sql(SQL_EWM.format(base=SQL_HOLES.strip(), value="v", source="pn"),
                                  f"SELECT series_id, step, {sr('y1')} AS v_ewm10, {sr('y3')} AS v_ewm30 FROM e"))
def smoothed_with_holes(spark, sf) -> DataFrame:
    """A third of the values missing: a missing value ages the smoothed level without changing it."""
    lanes = event_lanes(spark, sf)
    v = F.when(F.col("seq") % 3 != 0, F.col("sbp"))
    out = lanes.done(W.add_ewma(lanes, lanes.df, {"v": v}, (0.1, 0.3)))
    return pick(out, ["v_ewm10", "v_ewm30"])


@query("baseline_features", sql(SQL_PANEL + f""",
b AS (SELECT series_id, step, {sql_lag('sbp', 1)} AS l1, {sql_expand('avg', 'sbp')} AS m,
  {sql_expand('stddev_samp', 'sbp')} AS s FROM pn)""", f"""
SELECT series_id, step, {sr('m')} AS sbp_base_mean, {sr('s')} AS sbp_base_std, {sr('(l1 - m) / nullif(s, 0)')} AS sbp_z
FROM b"""))
def baseline_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), ["sbp_base_mean", "sbp_base_std", "sbp_z"])


@query("weight_features", sql(SQL_PANEL + f""",
b AS (SELECT series_id, step, count(weight) OVER (PARTITION BY series_id) > 3 AS ok, {sql_lag('weight', 1)} AS l1,
  {sql_slope('weight', 24)} AS s, {sql_expand('median', 'weight')} AS m FROM pn)""", f"""
SELECT series_id, step, {sr('CASE WHEN ok THEN l1 END')} AS weight_lag1, {sr('CASE WHEN ok THEN s END')} AS weight_slope24,
  {sr('CASE WHEN ok THEN l1 - m END')} AS weight_delta_base FROM b"""))
def weight_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), ["weight_lag1", "weight_slope24", "weight_delta_base"])


@query("pressure_features", sql(SQL_PANEL + f""",
p AS (SELECT *, sbp - dbp AS pp FROM pn),
b AS (SELECT series_id, step, {sql_lag('pp', 1)} AS l1, {sql_roll('avg', 'pp', 7, 3)} AS m7, {sql_expand('avg', 'pp')} AS m,
  {sql_expand('stddev_samp', 'pp')} AS s, {sql_lag('sbp', 1)} / nullif({sql_lag('dbp', 1)}, 0) AS ratio,
  {sql_roll('avg', 'days_since_last', 24, 4)} AS g FROM p)""", f"""
SELECT series_id, step, {sr('l1')} AS pp_lag1, {sr('m7')} AS pp_mean7, {sr('(l1 - m) / nullif(s, 0)')} AS pp_z,
  {sr('ratio')} AS sbp_dbp_ratio, {sr('g')} AS gap_mean24 FROM b"""))
def pressure_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), ["pp_lag1", "pp_mean7", "pp_z", "sbp_dbp_ratio", "gap_mean24"])


@query("contrast_features", sql(SQL_PANEL + f""",
b AS (SELECT series_id, step, {sql_roll('avg', 'sbp', 3, 2)} AS m3, {sql_roll('avg', 'sbp', 7, 2)} AS m7,
  {sql_roll('avg', 'sbp', 14, 4)} AS m14, {sql_roll('stddev_samp', 'sbp', 3, 2)} AS s3,
  {sql_roll('stddev_samp', 'sbp', 14, 4)} AS s14, {sql_expand('avg', 'sbp')} AS m FROM pn)""", f"""
SELECT series_id, step, {sr('m3 - m14')} AS sbp_mom_3_14, {sr('m7 - m')} AS sbp_excess_base,
  {sr('s3 / nullif(s14, 0)')} AS sbp_vol_ratio FROM b"""))
def contrast_features(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), ["sbp_mom_3_14", "sbp_excess_base", "sbp_vol_ratio"])


SQL_OVERLAY = SQL_PANEL.replace("pn AS (SELECT *,", "pnx AS (SELECT *,") + """,
pn AS (SELECT *, CAST(dbp + 20 AS DOUBLE) AS heart_rate, CASE WHEN dbp % 4 = 0 THEN 0 ELSE 1 END AS took_all_meds,
  CASE WHEN dbp % 4 = 0 AND dbp % 8 = 0 THEN 1 ELSE 0 END AS missed_antihypertensive,
  CASE WHEN dbp % 5 = 0 THEN 1 ELSE 0 END AS sym_dizziness, CASE WHEN dbp % 11 = 0 THEN 1 ELSE 0 END AS sym_edema,
  CASE WHEN dbp % 5 = 0 OR dbp % 11 = 0 THEN 1 ELSE 0 END AS sym_any,
  CASE WHEN dbp % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN dbp % 11 = 0 THEN 1 ELSE 0 END AS sym_count FROM pnx)"""


def overlay(df: DataFrame) -> DataFrame:
    """Heart rate, adherence and symptom columns derived from the panel's own second vital."""
    d = F.col("dbp")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return df.select("*", (d + 20).cast("double").alias("heart_rate"), flag(d % 4 != 0).alias("took_all_meds"),
                     flag(d % 8 == 0).alias("missed_antihypertensive"), flag(d % 5 == 0).alias("sym_dizziness"),
                     flag(d % 11 == 0).alias("sym_edema"), flag((d % 5 == 0) | (d % 11 == 0)).alias("sym_any"),
                     (flag(d % 5 == 0) + flag(d % 11 == 0)).alias("sym_count"))


def overlay_frame(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return W.build_features(lanes, CONFIG, overlay(lanes.df))


HIST = ("heart_rate", "took_all_meds", "missed_antihypertensive", "sym_any", "sym_count")


@query("history_features", sql(SQL_OVERLAY, "SELECT series_id, step, " + ", ".join(
    f"{sr(sql_lag(c, 1))} AS {c}_lag1, {sr(sql_roll('avg', c, 7, 2))} AS {c}_mean7, "
    f"{sr(sql_roll('avg', c, 30, 5))} AS {c}_mean30" for c in HIST) + " FROM pn"))
def history_features(spark, sf) -> DataFrame:
    return pick(overlay_frame(spark, sf), [f"{c}_{k}" for c in HIST for k in ("lag1", "mean7", "mean30")])


@query("heart_features", sql(SQL_OVERLAY + f""",
b AS (SELECT *, {sql_lag('heart_rate', 1)} AS l1, {sql_lag('heart_rate', 2)} AS l2, {sql_lag('sbp', 1)} AS s1,
  {sql_expand('avg', 'heart_rate')} AS m, {sql_expand('stddev_samp', 'heart_rate')} AS s FROM pn)""", f"""
SELECT series_id, step, {sr('(l1 - m) / nullif(s, 0)')} AS hr_z, {sr('l1 / nullif(s1, 0)')} AS shock_index_lag1,
  {sr('l1 - l2')} AS hr_d1, {sr('took_all_meds')} AS adh_took_all_meds_today,
  {sr('missed_antihypertensive')} AS adh_missed_antihypertensive_today FROM b"""))
def heart_features(spark, sf) -> DataFrame:
    return pick(overlay_frame(spark, sf), ["hr_z", "shock_index_lag1", "hr_d1", "adh_took_all_meds_today",
                                           "adh_missed_antihypertensive_today"])


@query("symptom_features", sql(SQL_OVERLAY, "SELECT series_id, step, " + ", ".join(
    f"{sr(sql_lag(c, 1))} AS {c}_lag1, {sr(sql_roll('avg', c, 30, 5))} AS {c}_rate30, "
    f"{sr(f'lead({c}, 1) OVER (PARTITION BY series_id ORDER BY ts)')} AS y_{c}_h1"
    for c in ("sym_dizziness", "sym_edema")) + " FROM pn"))
def symptom_features(spark, sf) -> DataFrame:
    return pick(overlay_frame(spark, sf), [f"{p}{c}{s}" for c in ("sym_dizziness", "sym_edema")
                                           for p, s in (("", "_lag1"), ("", "_rate30"), ("y_", "_h1"))])


@query("targets", sql(SQL_PANEL, "SELECT series_id, step, " + ", ".join(
    f"{sr(f'lead({s}, {h}) OVER (PARTITION BY series_id ORDER BY ts)')} AS y_{s}_h{h}"
    for s in ("sbp", "dbp") for h in (0, 1, 2)) + " FROM pn"))
def targets(spark, sf) -> DataFrame:
    return pick(feature_frame(spark, sf), [f"y_{s}_h{h}" for s in ("sbp", "dbp") for h in (0, 1, 2)])


@query("target_alignment", sql(SQL_PANEL, """
SELECT h, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM (SELECT unnest([0, 1, 2]) AS h) hs
JOIN pn a ON true JOIN pn b ON a.series_id = b.series_id AND b.step = a.step + h GROUP BY 1"""))
def target_alignment(spark, sf) -> DataFrame:
    from seriesloom.operators.leakage import target_mismatches
    return target_mismatches(feature_frame(spark, sf), "sbp", (0, 1, 2))


@query("line_item_features", """
SELECT l_partkey AS series_id, count(*) AS n, """ + ", ".join(
    f"{sr(f'avg({e})')} AS {n}" for n, e in (("lag1", "lag1"), ("mean7", "mean7"), ("std14", "std14"), ("slope7", "slope7"),
                                              ("base_mean", "base_mean"))) + """
FROM (SELECT l_partkey, lag(l_extendedprice) OVER w AS lag1,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 2
       THEN avg(l_extendedprice) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS mean7,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) >= 4
       THEN stddev_samp(l_extendedprice) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS std14,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
       THEN regr_slope(l_extendedprice, step) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS slope7,
  CASE WHEN count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 5
       THEN avg(l_extendedprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS base_mean
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_suppkey) - 1 AS step FROM lineitem)
  WINDOW w AS (PARTITION BY l_partkey ORDER BY step)) GROUP BY 1""")
def line_item_features(spark, sf) -> DataFrame:
    """The full feature set over the large panel, summarised per series."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_suppkey"]
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("series_id"), *order)
    lanes = lay_out(li, ["series_id"], order, reach=W.REACH, bound=longest(spark, sf, "lineitem", "l_partkey"))
    config = replace(CONFIG, signals=("l_extendedprice", "l_quantity"))
    f = W.build_features(lanes, config)
    s = "l_extendedprice"
    return f.groupBy("series_id").agg(F.count("*").alias("n"), *[
        r(F.avg(f"{s}_{n}")).alias(n) for n in ("lag1", "mean7", "std14", "slope7", "base_mean")])


@query("feature_list")
def feature_list(spark, sf) -> DataFrame:
    """Which columns a model may see, with their family, signal and density."""
    f = feature_frame(spark, sf)
    return W.feature_dictionary(f, W.feature_names(f))


@query("feature_density", sql(SQL_PANEL + f""",
b AS (SELECT {sql_lag('sbp', 7)} AS sbp_lag7, {sql_roll('avg', 'sbp', 30, 10)} AS sbp_mean30,
  {sql_roll('avg', 'days_since_last', 24, 4)} AS gap_mean24, days_since_last, is_male FROM pn)""", f"""
SELECT 'sbp_lag7' AS feature, 'lag' AS "group", 'sbp' AS signal, {sr('avg(CASE WHEN sbp_lag7 IS NULL THEN 0 ELSE 1 END)')} AS density FROM b
UNION ALL SELECT 'sbp_mean30', 'rolling moment', 'sbp', {sr('avg(CASE WHEN sbp_mean30 IS NULL THEN 0 ELSE 1 END)')} FROM b
UNION ALL SELECT 'gap_mean24', 'cadence', '-', {sr('avg(CASE WHEN gap_mean24 IS NULL THEN 0 ELSE 1 END)')} FROM b
UNION ALL SELECT 'days_since_last', 'cadence', '-', {sr('avg(CASE WHEN days_since_last IS NULL THEN 0 ELSE 1 END)')} FROM b
UNION ALL SELECT 'is_male', 'static', '-', {sr('avg(CASE WHEN is_male IS NULL THEN 0 ELSE 1 END)')} FROM b"""))
def feature_density(spark, sf) -> DataFrame:
    d = W.feature_dictionary(feature_frame(spark, sf), ["sbp_lag7", "sbp_mean30", "gap_mean24", "days_since_last", "is_male"])
    return d.select("feature", "group", "signal", r("density").alias("density"))


@query("walk_forward_rows", sql(SQL_PANEL + f""",
b AS (SELECT series_id, step, {sql_roll('avg', 'sbp', 7, 2)} AS m7, {sql_lag('sbp', 1)} AS l1 FROM pn),
n AS (SELECT series_id, max(step) + 1 AS step FROM pn GROUP BY 1),
t AS (SELECT p.series_id, avg(sbp) AS m7, last(sbp ORDER BY p.step) AS l1 FROM pn p JOIN n ON p.series_id = n.series_id
  WHERE p.step >= n.step - 7 GROUP BY 1)""", f"""
SELECT n.series_id, n.step, {sr('t.m7')} AS sbp_mean7, {sr('t.l1')} AS sbp_lag1
FROM n JOIN t ON n.series_id = t.series_id"""))
def walk_forward_rows(spark, sf) -> DataFrame:
    """The feature row that describes "now" for every series in one job."""
    lanes = panel(spark, sf)
    rows = lanes.done(lanes.df).select("series_id", "ts", "step", "sbp", "dbp", "days_since_last_raw")
    ahead = P.with_placeholders(rows).drop("step", "days_since_last_raw")
    again = lay_out(ahead, ["series_id"], ["ts"], reach=W.REACH, bound=event_bound(spark, sf) + 1)
    f = W.build_features(again, CONFIG, P.attach_cadence(again, again.df))
    return pick(f.where("is_placeholder"), ["sbp_mean7", "sbp_lag1"])
