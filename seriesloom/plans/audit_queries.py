"""Queries over statistics, drift, the data contract and leakage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.lanes import attach_row, lay_out
from seriesloom.functions.quantile import quantiles
from seriesloom.functions.skew import attach
from seriesloom.lineage import pin
from seriesloom.operators import contract as C
from seriesloom.operators import features as W
from seriesloom.operators import leakage as K
from seriesloom.operators import selection as X
from seriesloom.operators import stats as A
from seriesloom.plans.detector_queries import over_step
from seriesloom.plans.feature_queries import overlay, sql_expand, sql_lag, sql_roll, sql_slope
from seriesloom.plans.registry import query
from seriesloom.plans.roles import (CONFIG, EVENT_CONFIG, SQL_EVENT_PANEL, SQL_PANEL, SQL_SESSIONS, event_bound,
                                    event_panel, event_rows, panel, r, sessions, sql, sr, table)

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("quantiles_global", f"""
SELECT {sr('quantile_cont(l_extendedprice, 0.25)')} AS q25, {sr('quantile_cont(l_extendedprice, 0.5)')} AS q50,
  {sr('quantile_cont(l_extendedprice, 0.95)')} AS q95, {sr('quantile_cont(l_extendedprice, 0.99)')} AS q99 FROM lineitem""")
def quantiles_global(spark, sf) -> DataFrame:
    q = quantiles(table(spark, sf, "lineitem"), [], "l_extendedprice", {"q25": .25, "q50": .5, "q95": .95, "q99": .99})
    return q.select(*[r(c).alias(c) for c in ("q25", "q50", "q95", "q99")])


@query("quantiles_by_selection", f"""
SELECT l_returnflag, {sr('quantile_cont(l_extendedprice, 0.25)')} AS q25, {sr('quantile_cont(l_extendedprice, 0.9)')} AS q90
FROM lineitem GROUP BY 1""")
def quantiles_by_selection(spark, sf) -> DataFrame:
    """The plan for groups too large for one task: distinct counts, ranks over lanes, rank selection."""
    q = quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q25": .25, "q90": .9},
                  bound=2**62, group_rows=20_000)
    return q.select("l_returnflag", r("q25").alias("q25"), r("q90").alias("q90"))


@query("static_columns", """
SELECT 'dbp' AS feature, 0 AS is_static UNION ALL SELECT 'age', 1 UNION ALL SELECT 'is_male', 1 UNION ALL SELECT 'sbp', 0""")
def static_columns(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    s = A.static_columns(lanes.done(lanes.df), "series_id", ["sbp", "dbp", "age", "is_male"])
    return s.select("feature", F.col("is_static").cast("int").alias("is_static"))


@query("column_profile", sql(SQL_PANEL, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sr(f'avg(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)')} AS density, CAST(coalesce(min({c}) <> max({c}), false) AS INTEGER) AS varies FROM pn"
    for c in ("sbp", "weight", "idwg", "temperature", "uf_total"))))
def column_profile(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    p = A.profile(lanes.done(lanes.df), ["sbp", "weight", "idwg", "temperature", "uf_total"])
    return p.select("feature", r("density").alias("density"), F.col("varies").cast("int").alias("varies"))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {sr(f'corr({a}, {b})')} AS r FROM lineitem"
    for i, a in enumerate(LI) for b in LI[i + 1:]))
def correlation_matrix(spark, sf) -> DataFrame:
    return A.correlation_matrix(table(spark, sf, "lineitem"), LI).select("a", "b", "n", r("r").alias("r"))


@query("correlation_with_holes", sql(SQL_PANEL, " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count({a} + {b}) AS n, {sr(f'corr({a}, {b})')} AS r FROM pn"
    for a, b in (("sbp", "weight"), ("sbp", "uf_total"), ("weight", "uf_total")))))
def correlation_with_holes(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return A.correlation_matrix(lanes.done(lanes.df), ["sbp", "weight", "uf_total"]).select("a", "b", "n", r("r").alias("r"))


@query("target_correlations", sql(SQL_EVENT_PANEL + "," + over_step(f"""
f AS (SELECT {sql_lag('sbp', 1)} AS sbp_lag1, {sql_roll('avg', 'sbp', 7, 2)} AS sbp_mean7, sbp AS y_sbp_h0,
  lead(sbp, 1) OVER (PARTITION BY series_id ORDER BY step) AS y_sbp_h1 FROM ep)"""), " UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{t}' AS target, count({a} + {t}) AS n, {sr(f'corr({a}, {t})')} AS r FROM f"
    for a in ("sbp_lag1", "sbp_mean7") for t in ("y_sbp_h0", "y_sbp_h1"))))
def target_correlations(spark, sf) -> DataFrame:
    f = W.build_features(event_panel(spark, sf), EVENT_CONFIG)
    return A.pearson(f, ["sbp_lag1", "sbp_mean7"], ["y_sbp_h0", "y_sbp_h1"]).select("feature", "target", "n", r("r").alias("r"))


#: Features whose values are the same bit for bit in SQL, so that ties are ties there too.
EXACT = [*[f"{s}_lag{k}" for s in ("sbp", "dbp") for k in (1, 2, 3, 5, 7, 14)],
         *[f"{s}_{n}{w}" for s in ("sbp", "dbp") for w in (3, 7, 14, 30) for n in ("min", "max", "range")], "sbp_d1", "dbp_d1", "pp_lag1", "sbp_dbp_ratio",
         "age", "is_male", "is_dm", "has_afib", "has_cad", "has_hf", "is_pregnant", "on_ace", "on_bb", "on_loop", "k", "pulse", "missed_3d", "days_since_last"]
TARGETS = [f"y_{s}_h{h}" for s in ("sbp", "dbp") for h in (0, 1, 2)]


def sql_exact(name: str) -> str:
    """A feature of ``EXACT`` or a target as SQL over the event panel."""
    signal, _, rest = name.partition("_")
    if name.startswith("y_"):
        return f"lead({name[2:5]}, {name[-1]}) OVER (PARTITION BY series_id ORDER BY ts)"
    if name == "pp_lag1":
        return sql_lag("(sbp - dbp)", 1)
    if name == "sbp_dbp_ratio":
        return f"{sql_lag('sbp', 1)} / nullif({sql_lag('dbp', 1)}, 0)"
    if rest.startswith("lag"):
        return sql_lag(signal, int(rest[3:]))
    if rest == "d1":
        return f"{sql_lag(signal, 1)} - {sql_lag(signal, 2)}"
    for n in ("min", "max", "range"):
        if signal in ("sbp", "dbp") and rest.startswith(n):
            w = int(rest[len(n):])
            roll = lambda fn: sql_roll(fn, signal, w, max(2, w // 3))
            return f"{roll('max')} - {roll('min')}" if n == "range" else roll(n)
    return name


SQL_RANKS = SQL_EVENT_PANEL + "," + over_step(f"""
w AS (SELECT split, [{', '.join(f"CAST({sql_exact(f)} AS DOUBLE)" for f in EXACT)}] AS xs,
  [{', '.join(f"CAST({sql_exact(t)} AS DOUBLE)" for t in TARGETS)}] AS ys FROM ep)""") + f""",
fs AS (SELECT * FROM (SELECT unnest({EXACT}) AS feature, unnest(range({len(EXACT)})) AS f), (SELECT unnest({TARGETS}) AS target, unnest(range({len(TARGETS)})) AS t)),
l AS (SELECT feature, target, split, xs[f + 1] AS x, ys[t + 1] AS y FROM w, fs WHERE xs[f + 1] IS NOT NULL AND ys[t + 1] IS NOT NULL)"""
SQL_RHO = """,
k AS (SELECT *, rank() OVER (PARTITION BY feature, target ORDER BY x) + (count(*) OVER (PARTITION BY feature, target, x) - 1) / CAST(2 AS DOUBLE) AS rx,
  rank() OVER (PARTITION BY feature, target ORDER BY y) + (count(*) OVER (PARTITION BY feature, target, y) - 1) / CAST(2 AS DOUBLE) AS ry FROM {rows}),
c AS (SELECT feature, target, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r,
  CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM k GROUP BY 1, 2)"""


@query("rank_correlations", sql(SQL_RANKS + SQL_RHO.format(rows="l"), f"SELECT feature, target, n, {sr('rho')} AS rho FROM c"))
def rank_correlations(spark, sf) -> DataFrame:
    f = W.build_features(event_panel(spark, sf), EVENT_CONFIG)
    return A.spearman(f, EXACT, TARGETS).select("feature", "target", "n", r("rho").alias("rho"))


@query("selection_relevance", sql(SQL_RANKS + ", tr AS (SELECT * FROM l WHERE split = 'train')" + SQL_RHO.format(rows="tr"), f"""
SELECT feature, {sr('coalesce(max(greatest(coalesce(abs(r), 0), coalesce(abs(rho), 0))) FILTER (n >= 200), 0)')} AS relevance FROM c GROUP BY 1"""))
def selection_relevance(spark, sf) -> DataFrame:
    f = W.build_features(event_panel(spark, sf), EVENT_CONFIG).where("split = 'train'").select(*EXACT, *TARGETS)
    return X.relevance(pin(f), EXACT, TARGETS).select("feature", r("relevance").alias("relevance"))


@query("describe", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) AS n, {sr(f'avg({c})')} AS mean, {sr(f'stddev_samp({c})')} AS std, {sr(f'skewness({c})', 5)} AS skew,
  {sr(f'kurtosis({c})', 5)} AS kurt, {sr(f'quantile_cont({c}, 0.5)')} AS q50 FROM lineitem""" for c in LI))
def describe(spark, sf) -> DataFrame:
    d = A.describe(table(spark, sf, "lineitem"), LI)
    return d.select("feature", "n", r("mean").alias("mean"), r("std").alias("std"), r("skew", 5).alias("skew"),
                    r("kurt", 5).alias("kurt"), r("q50").alias("q50"))


def head_tail(spark, sf) -> tuple[DataFrame, DataFrame]:
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@query("ks_drift", sql(SQL_EVENT_PANEL + """,
b AS (SELECT 'sbp' AS feature, sbp AS v, CASE WHEN split = 'train' THEN 1 ELSE 0 END AS a FROM ep WHERE split <> 'val'
  UNION ALL SELECT 'dbp', dbp, CASE WHEN split = 'train' THEN 1 ELSE 0 END FROM ep WHERE split <> 'val'),
c AS (SELECT feature, v, sum(a) AS x, sum(1 - a) AS y FROM b GROUP BY 1, 2),
d AS (SELECT feature, sum(x) OVER w / CAST(sum(x) OVER (PARTITION BY feature) AS DOUBLE) AS fx,
  sum(y) OVER w / CAST(sum(y) OVER (PARTITION BY feature) AS DOUBLE) AS fy FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING))""", f"""
SELECT feature, {sr('max(abs(fx - fy))')} AS statistic FROM d GROUP BY 1"""))
def ks_drift(spark, sf) -> DataFrame:
    a, b = head_tail(spark, sf)
    return A.ks_two_sample(a, b, ["sbp", "dbp"], bound=event_rows(spark, sf)).select("feature", r("statistic").alias("statistic"))


@query("ks_by_ship_year", "WITH b AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, CASE WHEN year(l_shipdate) < 1998 THEN 1 ELSE 0 END AS a FROM lineitem" for c in LI) + f"""),
c AS (SELECT feature, v, sum(a) AS x, sum(1 - a) AS y FROM b GROUP BY 1, 2),
d AS (SELECT feature, sum(x) OVER (PARTITION BY feature) AS nx, sum(y) OVER (PARTITION BY feature) AS ny, sum(x) OVER w AS cx, sum(y) OVER w AS cy FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
k AS (SELECT feature, CAST(max(nx) AS BIGINT) AS n_base, CAST(max(ny) AS BIGINT) AS n_current, max(abs(cx / CAST(nx AS DOUBLE) - cy / CAST(ny AS DOUBLE))) AS s
  FROM d GROUP BY 1),
l AS (SELECT *, sqrt(n_base * CAST(n_current AS DOUBLE) / (n_base + n_current)) * s AS lam FROM k),
p AS (SELECT feature, min(n_base) AS n_base, min(n_current) AS n_current, min(s) AS s,
  least(greatest(sum(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * i * i * lam * lam)), 0), 1) AS p FROM l, range(1, 101) t(i) GROUP BY 1)
SELECT feature, n_base, n_current, {sr('s')} AS statistic, {sr('p')} AS p_value, p < 0.05 AS drift FROM p""")
def ks_by_ship_year(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    mid = F.year("l_shipdate") < 1998
    k = A.ks_two_sample(li.where(mid), li.where(~mid), LI)
    return k.select("feature", "n_base", "n_current", r("statistic").alias("statistic"), r("p_value").alias("p_value"), "drift")


def sql_psi(columns, ref, cur, source):
    parts = []
    for c in columns:
        parts.append(f"""
SELECT '{c}' AS feature, sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))) AS psi FROM (
  SELECT b, count(*) FILTER (WHERE {ref}) / CAST((SELECT count(*) FROM {source} WHERE {ref} AND {c} IS NOT NULL) AS DOUBLE) AS e,
    count(*) FILTER (WHERE {cur}) / CAST((SELECT count(*) FROM {source} WHERE {cur} AND {c} IS NOT NULL) AS DOUBLE) AS a
  FROM (SELECT *, len(list_filter((SELECT list_distinct(quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) FROM {source} WHERE {ref}),
    lambda x: x <= {c})) AS b FROM {source} WHERE {c} IS NOT NULL) GROUP BY b)""")
    return " UNION ALL ".join(parts)


@query("population_stability", sql(SQL_EVENT_PANEL, f"SELECT feature, {sr('psi')} AS psi FROM (" + sql_psi(
    ["sbp", "dbp", "pulse"], "split = 'train'", "split = 'test'", "ep") + ")"))
def population_stability(spark, sf) -> DataFrame:
    a, b = head_tail(spark, sf)
    return A.psi(a, b, ["sbp", "dbp", "pulse"], bound=event_rows(spark, sf)).select("feature", r("psi").alias("psi"))


@query("drift_monitor")
def drift_monitor(spark, sf) -> DataFrame:
    """Feature drift of the test tail against train, most moved first."""
    f = W.build_features(event_panel(spark, sf), EVENT_CONFIG)
    names = [f"{s}_{n}" for s in ("sbp", "dbp") for n in ("lag1", "mean7", "mean14", "std7", "slope7", "z", "ewm30")]
    names = [*names, "gap_mean24"]
    f = pin(f.where("split IN ('train', 'test')").select("split", *names))                 # edges and counts scan it
    scores = A.psi(f.where("split = 'train'"), f.where("split = 'test'"), names, bound=event_rows(spark, sf))
    return A.drift_report(scores).withColumn("response", A.response("status"))


@query("monitoring", sql(SQL_EVENT_PANEL + "," + over_step(f"""
e AS (SELECT split, abs(sbp - {sql_lag('sbp', 1)}) AS err, sbp >= 180 AS alert FROM ep),
g AS (SELECT avg(err) FILTER (WHERE split = 'val') AS ref_mae, avg(err) FILTER (WHERE split = 'test') AS cur_mae,
  avg(CASE WHEN alert THEN 1 ELSE 0 END) FILTER (WHERE split = 'val') AS ref_rate,
  avg(CASE WHEN alert THEN 1 ELSE 0 END) FILTER (WHERE split = 'test') AS cur_rate FROM e)"""), f"""
SELECT 'forecast error' AS signal, {sr('ref_mae')} AS reference, {sr('cur_mae')} AS current,
  CASE WHEN (cur_mae - ref_mae) / ref_mae > 0.1 THEN 'ALARM' ELSE 'ok' END AS status FROM g
UNION ALL SELECT 'alert rate', {sr('ref_rate')}, {sr('cur_rate')},
  CASE WHEN abs(cur_rate - ref_rate) / greatest(ref_rate, 1e-9) > 0.5 THEN 'ALARM' ELSE 'ok' END FROM g"""))
def monitoring(spark, sf) -> DataFrame:
    """Forecast-error drift (10 %) and alert-rate drift (50 %) of the newest tail, each against a realised rate."""
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df.withColumn("err", F.abs(F.col("sbp") - F.lag("sbp").over(lanes.window))))
    part = lambda s, c: F.avg(F.when(F.col("split") == s, c))
    alert = (F.col("sbp") >= 180).cast("double")
    one = rows.agg(part("val", F.col("err")).alias("a"), part("test", F.col("err")).alias("b"),
                   part("val", alert).alias("c"), part("test", alert).alias("d"))
    _, s1 = A.rate_drift("b", "a", 0.10, False)
    _, s2 = A.rate_drift("d", "c", 0.50, True)
    line = lambda n, x, y, s: F.struct(F.lit(n).alias("signal"), r(x).alias("reference"), r(y).alias("current"), s.alias("status"))
    return one.select(F.inline(F.array(line("forecast error", "a", "b", s1), line("alert rate", "c", "d", s2))))


@query("cadence_drift", sql(SQL_PANEL, f"SELECT feature, {sr('psi')} AS psi FROM (" + sql_psi(
    ["days_since_last_raw"], "split = 'train'", "split = 'test'", "pn") + ")"))
def cadence_drift(spark, sf) -> DataFrame:
    """Stability of the unclipped gap as a signal of its own."""
    lanes = panel(spark, sf)
    rows = lanes.done(lanes.df)
    p = A.psi(rows.where("split = 'train'"), rows.where("split = 'test'"), ["days_since_last_raw"], bound=event_rows(spark, sf))
    return p.select("feature", r("psi").alias("psi"))


@query("variance_shares", sql(SQL_EVENT_PANEL + """,
p AS (SELECT series_id, count(sbp) AS n, avg(sbp) AS m, stddev_samp(sbp) AS s, var_pop(sbp) AS vp FROM ep GROUP BY 1),
g AS (SELECT sum(n * m) / sum(n) AS g FROM p WHERE n > 10),
a AS (SELECT sum(n * (m - g) * (m - g)) AS ssb, sum(n * vp) AS ssw, count(*) AS k, sum(n) AS n FROM p, g WHERE n > 10),
b AS (SELECT stddev_samp(m) AS b, avg(s) AS w FROM p)""", f"""
SELECT {sr('b')} AS between_sd, {sr('w')} AS within_sd, {sr('b * b / (b * b + w * w)')} AS between_share,
  {sr('(ssb / (k - 1)) / (ssw / (n - k))')} AS anova_f FROM a, b"""))
def variance_shares(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    v = A.variance_shares(lanes.done(lanes.df), "series_id", "sbp")
    return v.select(*[r(c).alias(c) for c in ("between_sd", "within_sd", "between_share", "anova_f")])


@query("autocorrelation", sql(SQL_EVENT_PANEL + """,
y AS (SELECT series_id, step, sbp - avg(sbp) OVER (PARTITION BY series_id) AS y, count(*) OVER (PARTITION BY series_id) AS n FROM ep),
d AS (SELECT series_id, sum(y * y) AS d FROM y WHERE n >= 40 GROUP BY 1),
a AS (SELECT k, p.series_id, sum(p.y * q.y) AS s FROM (SELECT unnest(range(1, 21)) AS k) ks JOIN y p ON p.n >= 40
  JOIN y q ON p.series_id = q.series_id AND q.step = p.step - k GROUP BY 1, 2)""", f"""
SELECT CAST(k AS INTEGER) AS lag, count(*) AS n_series, {sr('avg(s / d)')} AS acf FROM a JOIN d ON a.series_id = d.series_id GROUP BY 1"""))
def autocorrelation(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    return A.autocorrelation(lanes, lanes.df, "sbp").select("lag", "n_series", r("acf").alias("acf"))


@query("lag_one_r2", sql(SQL_EVENT_PANEL + """,
x AS (SELECT series_id, sbp, lag(sbp) OVER (PARTITION BY series_id ORDER BY step) AS p FROM ep)""", f"""
SELECT series_id, {sr('corr(sbp, p) * corr(sbp, p)')} AS r2 FROM x GROUP BY 1 HAVING count(sbp) > 30"""))
def lag_one_r2(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    return A.lag_one_r2(lanes, lanes.df, "sbp").select("series_id", r("r2").alias("r2"))


@query("pooled_vs_within", sql(SQL_EVENT_PANEL + """,
x AS (SELECT sbp, sbp - avg(sbp) OVER s AS a, avg(dbp) OVER s AS mb, dbp AS b0, lag(dbp, 1) OVER w AS b1, lag(dbp, 2) OVER w AS b2,
  lag(dbp, 3) OVER w AS b3 FROM ep WINDOW s AS (PARTITION BY series_id), w AS (PARTITION BY series_id ORDER BY step))""", " UNION ALL ".join(
    f"SELECT {k} AS lag, {sr(f'corr(sbp, b{k})')} AS pooled, {sr(f'corr(a, b{k} - mb)')} AS within_series, {sr(f'corr(sbp, b{k}) - corr(a, b{k} - mb)')} AS artefact FROM x"
    for k in range(4))))
def pooled_vs_within(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    p = A.pooled_vs_within(lanes, lanes.df, "sbp", "dbp")
    return p.select("lag", r("pooled").alias("pooled"), r("within").alias("within_series"), r("artefact").alias("artefact"))


@query("odds_ratio", f"""
SELECT {sr('''(count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05) + 0.5) * (count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount <= 0.05) + 0.5)
  / ((count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount <= 0.05) + 0.5) * (count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount > 0.05) + 0.5))''')}
  AS odds_ratio FROM lineitem""")
def odds_ratio(spark, sf) -> DataFrame:
    o = A.odds_ratio(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", F.col("l_discount") > 0.05)
    return o.select(r("odds_ratio").alias("odds_ratio"))


@query("pressure_reference", sql(SQL_EVENT_PANEL + """,
p AS (SELECT sbp - dbp AS pp FROM ep), m AS (SELECT quantile_cont(pp, 0.5) AS m FROM p)""", f"""
SELECT count(*) AS n, {sr('quantile_cont(pp, 0.001)')} AS pp_p001, {sr('quantile_cont(pp, 0.5)')} AS pp_p50,
  {sr('quantile_cont(pp, 0.999)')} AS pp_p999, {sr('quantile_cont(abs(pp - m), 0.99)')} AS pp_abs_dev_p99 FROM p, m"""))
def pressure_reference(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    p = A.pressure_reference(lanes.done(lanes.df), bound=event_rows(spark, sf))
    return p.select("n", *[r(c).alias(c) for c in ("pp_p001", "pp_p50", "pp_p999", "pp_abs_dev_p99")])


@query("missing_by_series", sql(SQL_PANEL, f"""
SELECT series_id, {sr('avg(CASE WHEN weight IS NULL THEN 1 ELSE 0 END)')} AS weight, {sr('avg(CASE WHEN uf_total IS NULL THEN 1 ELSE 0 END)')} AS uf_total
FROM pn GROUP BY 1"""))
def missing_by_series(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    miss = lambda c: r(F.avg(F.col(c).isNull().cast("double"))).alias(c)
    return lanes.done(lanes.df).groupBy("series_id").agg(miss("weight"), miss("uf_total"))


@query("event_base_rates", sql(SQL_EVENT_PANEL + """,
q AS (SELECT series_id, quantile_cont(sbp, 0.95) AS thr, count(*) AS n FROM ep GROUP BY 1),
x AS (SELECT ep.series_id, thr, n, greatest(lead(sbp, 1) OVER w, lead(sbp, 2) OVER w, lead(sbp, 3) OVER w) AS mx, lead(sbp, 3) OVER w AS a3
  FROM ep JOIN q ON ep.series_id = q.series_id WINDOW w AS (PARTITION BY ep.series_id ORDER BY step))""", f"""
SELECT series_id, {sr('min(thr)')} AS threshold, {sr('avg(CASE WHEN a3 IS NOT NULL THEN CASE WHEN mx >= thr THEN 1 ELSE 0 END END)')} AS base_rate
FROM x WHERE n >= 30 GROUP BY 1"""))
def event_base_rates(spark, sf) -> DataFrame:
    lanes = event_panel(spark, sf)
    q = quantiles(lanes.done(lanes.df), ["series_id"], "sbp", {"threshold": 0.95}, event_bound(spark, sf))
    w = lanes.window
    ahead = [F.lead("sbp", i).over(w) for i in (1, 2, 3)]
    d = lanes.whole(lanes.df.select("*", ahead[2].alias("_a3"), F.greatest(*ahead).alias("_mx")), _n=F.count("*"))
    rows = attach(lanes.done(d).where("_n >= 30"), q, "series_id", "inner", lanes.longest)
    hit = F.when(F.col("_a3").isNotNull(), (F.col("_mx") >= F.col("threshold")).cast("double"))
    return rows.groupBy("series_id").agg(r(F.min("threshold")).alias("threshold"), r(F.avg(hit)).alias("base_rate"))


# ---- contract and audits ----------------------------------------------------------------------------

def check_sql(items) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "check", CASE WHEN {ok} THEN 'PASS' ELSE '{'FAIL' if crit else 'WARN'}' END AS status, {sr(v)} AS value FROM a"""
        for n, ok, v, crit in items)


def shown(checks: DataFrame) -> DataFrame:
    return checks.select("check", "status", r("value").alias("value"))


@query("contract_schema")
def contract_schema(spark, sf) -> DataFrame:
    s = sessions(spark, sf)
    req = {"series_id": "text", "ts": "datetime", "sbp": "number", "dbp": "number"}
    checks = C.schema_checks(s, req, ["weight", "idwg", "session_source", "pulse"])
    return attach_row(checks, s.agg(F.count("*").alias("rows_checked")))


RANGES = {"sbp": (60, 260), "dbp": (30, 160), "weight": (25, 220), "session_hours": (0.5, 12.0)}


@query("contract_ranges", sql(SQL_SESSIONS + ", a AS (SELECT " + ", ".join(
    f"avg(CASE WHEN {c} BETWEEN {lo} AND {hi} THEN 0 WHEN {c} IS NOT NULL THEN 1 END) AS {c}" for c, (lo, hi) in RANGES.items())
    + ", avg(CASE WHEN sbp - dbp < 10 THEN 1 ELSE 0 END) AS pp FROM sess)", check_sql(
    [(f"range: {c} in [{lo}, {hi}]", f"{c} IS NULL OR {c} < 0.005", c, False) for c, (lo, hi) in RANGES.items()]
    + [("range: pulse pressure", "pp < 0.005", "pp", False)])))
def contract_ranges(spark, sf) -> DataFrame:
    return shown(C.range_checks(sessions(spark, sf), RANGES))


@query("contract_structure", sql(SQL_PANEL + """,
x AS (SELECT *, lag(ts) OVER w AS pt, sbp = lag(sbp) OVER w AND dbp = lag(dbp) OVER w AND days_since_last_raw = 1 AS flat FROM pn
  WINDOW w AS (PARTITION BY series_id ORDER BY step)),
a AS (SELECT (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM pn GROUP BY series_id, ts)) AS dup,
  count(*) FILTER (WHERE ts < pt) AS back, count(*) FILTER (WHERE days_since_last_raw <= 0) AS nonpos,
  avg(CASE WHEN days_since_last_raw > 30 THEN 1 WHEN days_since_last_raw IS NOT NULL THEN 0 END) AS clipped,
  avg(CASE WHEN days_since_last_raw > 14 THEN 1 WHEN days_since_last_raw IS NOT NULL THEN 0 END) AS stale,
  avg(CASE WHEN flat THEN 1 ELSE 0 END) AS flat, (SELECT count(*) FROM (SELECT series_id FROM pn GROUP BY 1 HAVING count(*) < 20)) AS short FROM x)""",
    check_sql([("structure: unique (series, session)", "dup = 0", "dup", True),
               ("structure: timestamps increasing within series", "back = 0", "back", True),
               ("structure: session gaps strictly positive", "nonpos = 0", "nonpos", True),
               ("structure: the clip is a guard, not a transform", "clipped < 0.01", "clipped", True),
               ("structure: stale gaps are rare", "stale < 0.005", "stale", False),
               ("structure: no forward-filled runs", "flat < 0.05", "flat", True),
               ("structure: every series is long enough", "short = 0", "short", True)])))
def contract_structure(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return shown(C.structure_checks(lanes, lanes.df, 20))


@query("contract_reconciliation", sql(SQL_SESSIONS + """,
a AS (SELECT count(*) / CAST((SELECT count(*) FROM rec) AS DOUBLE) AS ratio,
  avg(CASE WHEN session_source <> 'd1' THEN 1 ELSE 0 END) AS wo, quantile_cont(session_hours, 0.5) AS h FROM sess)""",
    check_sql([("reconciliation: session ratio in band", "ratio BETWEEN 1.1 AND 1.3", "ratio", True),
               ("reconciliation: sessions carry a record", "wo <= 0.25", "wo", True),
               ("reconciliation: median duration", "h BETWEEN 2 AND 6", "h", False)])))
def contract_reconciliation(spark, sf) -> DataFrame:
    from seriesloom.plans.roles import records
    published = records(spark, sf).agg(F.count("*").alias("published"))
    return shown(C.reconciliation_checks(sessions(spark, sf), published, bound=event_rows(spark, sf)))


@query("contract_referential", sql(SQL_PANEL + """,
a AS (SELECT count(*) FILTER (WHERE age IS NULL) AS un, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM pn GROUP BY series_id, ts)) AS dup,
  0 AS vary FROM pn)""", check_sql([("join: demographics matched", "un = 0", "un", False),
                                    ("join: merge did not duplicate rows", "dup = 0", "dup", True),
                                    ("join: demographics constant within series", "vary = 0", "vary", False)])))
def contract_referential(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return shown(C.referential_checks(lanes.done(lanes.df)))


@query("contract_self_test", """
SELECT * FROM (VALUES ('duplicate last row', 'FAIL'), ('timestamp moved back', 'FAIL'), ('one long gap', 'FAIL'),
  ('filled daily grid', 'FAIL'), ('too few sessions', 'FAIL')) v(corruption, status)""")
def contract_self_test(spark, sf) -> DataFrame:
    """The whole panel, damaged in five ways: each damage must be caught by its own check."""
    lanes = panel(spark, sf)
    rows = lanes.done(lanes.df).select("series_id", "ts", "step", "sbp", "dbp", "days_since_last_raw", "days_since_last")
    return C.self_test(rows, 20, bound=event_bound(spark, sf) + 1).select("corruption", "status")


@query("cadence_audit", sql(SQL_PANEL + """,
a AS (SELECT 0 AS off, min(days_since_last) AS lo, max(days_since_last) AS hi, count(*) FILTER (WHERE days_since_last_raw <= 0) AS np,
  avg(CASE WHEN days_since_last_raw > 30 THEN 1 WHEN days_since_last_raw IS NOT NULL THEN 0 END) AS ov,
  avg(CASE WHEN days_since_last_raw > 14 THEN 1 WHEN days_since_last_raw IS NOT NULL THEN 0 END) AS st FROM pn)""",
    check_sql([("raw gap is present", "true", "1", True), ("raw gap is not a feature", "true", "0", True),
               ("gap equals its recomputation", "off = 0", "off", True),
               ("gap stays inside the bounds", "lo >= 1 AND hi <= 30", "hi", True), ("raw gaps are positive", "np = 0", "np", True),
               ("the clip is a guard", "ov < 0.01", "ov", True), ("stale gaps are rare", "st < 0.005", "st", False)])))
def cadence_audit(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    return shown(C.cadence_audit(lanes, lanes.df, ["sbp_lag1", "days_since_last"]))


@query("leakage_structure")
def leakage_structure(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    f = W.build_features(lanes, CONFIG, lanes.df.withColumn("_before", F.lag("sbp").over(lanes.window)))
    names = [n for n in W.feature_names(f) if not n.startswith("weight")]
    keep = ["series_id", "step", "split", "patient_split", "sbp", "_before", "y_sbp_h0", "y_sbp_h1", "y_sbp_h2"]
    return K.structural_audit(pin(f.select(*dict.fromkeys([*keep, *names]))), names, before="_before")


def future_sql() -> dict[str, str]:
    """Features as SQL over ``bp``, the panel in which the later half may be raised."""
    out = {f: sql_exact(f) for f in EXACT if f.startswith(("sbp_", "dbp_", "pp_"))}
    for s in ("sbp", "dbp"):
        out |= {f"{s}_{n}{w}": sql_roll(fn, s, w, max(2, w // 3)) for w in (3, 7, 14, 30) for n, fn in (("mean", "avg"), ("std", "stddev_samp"))}
        out |= {f"{s}_slope{w}": sql_slope(s, w) for w in (3, 7, 14, 30)}
        out |= {f"{s}_base_mean": sql_expand("avg", s), f"{s}_base_std": sql_expand("stddev_samp", s)}
        out[f"{s}_z"] = f"({sql_lag(s, 1)} - {out[f'{s}_base_mean']}) / nullif({out[f'{s}_base_std']}, 0)"
        out[f"{s}_mom_3_14"] = f"{out[f'{s}_mean3']} - {out[f'{s}_mean14']}"
        out[f"{s}_excess_base"] = f"{out[f'{s}_mean7']} - {out[f'{s}_base_mean']}"
        out[f"{s}_vol_ratio"] = f"{out[f'{s}_std3']} / nullif({out[f'{s}_std14']}, 0)"
    out["pp_mean7"] = sql_roll("avg", "(sbp - dbp)", 7, 3)
    out["gap_mean24"] = sql_roll("avg", "days_since_last", 24, 4)
    return out


FUTURE = future_sql()


def corrupted(spark, sf, features) -> DataFrame:
    """Raise the later half of every series by 50 and rebuild: no earlier feature may move."""
    lanes = panel(spark, sf)
    names = features or W.feature_names(W.build_features(lanes, CONFIG))
    return K.future_corruption(lanes, lanes.df, lambda at, df: W.with_features(at, CONFIG, df), names)


@query("leakage_future", sql(SQL_PANEL + """,
hp AS (SELECT *, floor((max(step) OVER (PARTITION BY series_id) + 1) / 2) AS mid FROM pn),
bp AS (SELECT hp.* REPLACE (CASE WHEN bent = 1 AND step >= mid THEN sbp + 50 ELSE sbp END AS sbp), bent FROM hp, (SELECT unnest([0, 1]) AS bent)),
vs AS (SELECT series_id, step, mid, bent, [""" + ", ".join(f"CAST({x} AS DOUBLE)" for x in FUTURE.values()).replace(
    "PARTITION BY series_id", "PARTITION BY bent, series_id") + f"""] AS v FROM bp),
pr AS (SELECT a.v AS a, b.v AS b FROM vs a JOIN vs b ON a.series_id = b.series_id AND a.step = b.step AND a.bent = 0 AND b.bent = 1 WHERE a.step < a.mid),
fs AS (SELECT unnest({list(FUTURE)}) AS feature, unnest(range({len(FUTURE)})) AS i)""", """
SELECT feature, count(*) AS n_rows, CAST(count(*) FILTER (WHERE NOT (a[i + 1] IS NOT DISTINCT FROM b[i + 1]
  OR coalesce(abs(a[i + 1] - b[i + 1]) <= 1e-6 + 1e-6 * abs(b[i + 1]), false))) AS BIGINT) AS n_moved FROM pr, fs GROUP BY 1"""))
def leakage_future(spark, sf) -> DataFrame:
    return corrupted(spark, sf, list(FUTURE))


@query("leakage_future_all")
def leakage_future_all(spark, sf) -> DataFrame:
    """The same probe over every feature, those that SQL has no short form for included."""
    return corrupted(spark, sf, None)


@query("leakage_labels")
def leakage_labels(spark, sf) -> DataFrame:
    lanes = panel(spark, sf)
    f = W.build_features(lanes, CONFIG, overlay(lanes.df))
    again = lay_out(f.drop("step"), ["series_id"], ["ts"], reach=1, bound=event_bound(spark, sf))
    return K.label_reproduction(again, again.df, [c for c in f.columns if c.startswith(("sym_", "adh_"))])


@query("newest_row_coverage")
def newest_row_coverage(spark, sf) -> DataFrame:
    f = W.build_features(panel(spark, sf), CONFIG)
    last = f.groupBy("series_id").agg(F.max_by(F.struct(*[c for c in f.columns if c != "series_id"]), "step").alias("l")).select(
        "series_id", "l.*")
    names = [n for n in W.feature_names(f) if n.startswith(("sbp", "dbp", "weight", "pp", "gap"))]
    return K.last_row_coverage(last, names, ["sbp", "dbp", "pp", "gap"], ["weight"])


@query("report_verification")
def report_verification(spark, sf) -> DataFrame:
    """Assertions over report tables; the report nobody wrote is a WARN."""
    lanes = panel(spark, sf)
    rows = lanes.done(lanes.df)
    reports = {"contract": C.structure_checks(lanes, lanes.df, 20), "splits": rows.groupBy("split").count(), "absent": None}
    return C.verify_reports(reports, {
        "no critical contract failure": ("contract", F.count_if(F.col("status") == "FAIL") == 0),
        "three splits": ("splits", F.count("*") == 3), "report that does not exist": ("absent", F.lit(True))})


@query("row_overlap", sql(SQL_EVENT_PANEL, """
SELECT CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE split <> 'train') AS BIGINT) AS n_scored,
  (SELECT count(*) FROM (SELECT series_id, step FROM ep WHERE split = 'train' INTERSECT SELECT series_id, step FROM ep WHERE split <> 'train')) AS n_shared
FROM ep"""))
def row_overlap(spark, sf) -> DataFrame:
    """No scored row is a training row."""
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df).select("series_id", "step", "split")
    train, scored = (rows.where(c).select("series_id", "step") for c in ("split = 'train'", "split <> 'train'"))
    shared = train.intersect(scored).agg(F.count("*").alias("n_shared"))
    return attach_row(attach_row(train.agg(F.count("*").alias("n_train")), scored.agg(F.count("*").alias("n_scored"))), shared)


@query("overlay_merge", sql(SQL_EVENT_PANEL, f"""
SELECT split, count(*) AS n, count(s) AS n_marked, {sr('avg(CASE WHEN s IS NOT NULL THEN sbp END)')} AS mean_marked
FROM (SELECT a.split, a.sbp, b.dizziness AS s FROM ep a LEFT JOIN (SELECT * FROM ep WHERE k % 2 = 0) b
  ON a.series_id = b.series_id AND a.step = b.step) GROUP BY 1"""))
def overlay_merge(spark, sf) -> DataFrame:
    """A clinical layer that covers some rows, merged on (series, step): uncovered rows keep nulls."""
    lanes = event_panel(spark, sf)
    rows = lanes.done(lanes.df)
    layer = rows.where(F.col("k") % 2 == 0).select("series_id", "step", F.col("dizziness").alias("s"))
    j = rows.select("series_id", "step", "split", "sbp").join(layer, ["series_id", "step"], "left")
    return j.groupBy("split").agg(F.count("*").alias("n"), F.count("s").alias("n_marked"),
                                  r(F.avg(F.when(F.col("s").isNotNull(), F.col("sbp")))).alias("mean_marked"))
