"""Forecasts: baselines, smoothers, per-series models, ensembles, bands, coherence, back-tests, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.config import MIN_PULSE_PRESSURE, RANGES
from seriesloom.functions.quantile import quantiles
from seriesloom.functions.skew import attach
from seriesloom.lineage import pin
from seriesloom.operators.features import ewm_name

BASELINES = ("persistence", "seasonal_naive_7", "drift", "personal_mean", "ewma")


def baseline(model: str, s: str, h: int) -> Column:
    """Closed-form forecasts over features; drift at h = 0 equals persistence."""
    c = lambda n: F.col(f"{s}_{n}")
    return {"persistence": c("lag1"), "seasonal_naive_7": c("lag7"), "drift": c("lag1") + h * (c("lag1") - c("lag2")),
            "personal_mean": c("base_mean"), "ewma": F.col(ewm_name(s, 0.3))}[model]


def baseline_columns(signals: Sequence[str]) -> set[str]:
    """Columns selection must keep so that every baseline can serve."""
    return {f"{s}_{n}" for s in signals for n in ("lag1", "lag2", "base_mean", "ewm30")}


def baselines_long(frame: DataFrame, signal: str, horizons: Sequence[int], keep: Sequence[str],
                   models: Sequence[str] = BASELINES) -> DataFrame:
    """One row per (row, horizon, model) with truth ``y`` and forecast ``p``."""
    cells = [F.struct(F.lit(h).alias("h"), F.col(f"y_{signal}_h{h}").cast("double").alias("y"), F.lit(m).alias("model"),
                      baseline(m, signal, h).cast("double").alias("p")) for h in horizons for m in models]
    return frame.select(*keep, F.inline(F.array(*cells)))


# ---- smoothers ---------------------------------------------------------------------------------------

HOLT_GRID = [(a, b, p) for a in (0.1, 0.3, 0.5) for b in (0.0, 0.05, 0.2) for p in (0.8, 0.98)]
SES = (0.3, 0.0, 0.0)       # phi = 0 leaves plain exponential smoothing, the level of the theta method


def _run(values, level, trend, a, b, phi, before=None):
    """Walk the recursion; ``before`` collects the state ahead of every value."""
    for i, v in enumerate(values):
        if before is not None:
            before[0][i], before[1][i] = level, trend
        prev = level
        level = a * v + (1 - a) * (level + phi * trend)
        trend = b * (level - prev) + (1 - b) * phi * trend
    return level, trend


def holt_states(df: DataFrame, key: str, order: Sequence[str], value: str, configs=((0.3, 0.05, 0.9),),
                bound: int | None = None) -> DataFrame:
    """Damped-trend state ahead of every known value: key, order columns, value, step, first, level[], trend[].

    One task walks one series. A series too long for that is cut into lanes; the recursion is linear, so a
    lane is summed up by where it takes three start states, the lanes are chained on those summaries, and
    every lane then runs from its true start.
    """
    import numpy as np
    from seriesloom.functions.lanes import lay_out
    known = df.where(F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias("_v"))
    lanes = lay_out(known, [key], list(order), bound=bound)
    rows = lanes.df.where(~F.col("_echo")) if lanes.split else lanes.df
    part = list(lanes.part)
    a, b, phi = (np.array([c[i] for c in configs]) for i in range(3))
    n = len(configs)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"`{c}` {fields[c]}" for c in [key, *order])
    schema = f"{head}, step long, _v double, level array<double>, trend array<double>"
    keep = [key, *order, "step", "_v"]

    def walk(pdf, start=None):
        pdf = pdf.sort_values("step")
        v = pdf["_v"].to_numpy(float)
        levels, trends = np.full((len(v), n), np.nan), np.full((len(v), n), np.nan)
        if start is None:
            level, trend = np.full(n, v[0]), np.full(n, (v[1] - v[0]) if len(v) > 1 else 0.0)
            if len(v) > 1:
                levels[1], trends[1] = v[0], np.nan        # one value seen: the forecast is that value
            level, trend = _run(v[1:2], level, trend, a, b, phi)
            _run(v[2:], level, trend, a, b, phi, (levels[2:], trends[2:]))
            if len(v) > 2:
                levels[2], trends[2] = v[1], np.nan        # two values seen: still the last value
        else:
            _run(v, start[0], start[1], a, b, phi, (levels, trends))
        out = pdf[keep].copy()
        out["level"], out["trend"] = list(levels), list(trends)
        return out

    if not lanes.split:
        return rows.select(*keep).groupBy(key).applyInPandas(lambda pdf: walk(pdf), schema)

    def summarise(pdf):
        pdf = pdf.sort_values("step")
        v = pdf["_v"].to_numpy(float)
        first = int(pdf["step"].iloc[0]) == 0
        if first:
            base = _run(v[1:], np.full(n, v[0]), np.full(n, v[1] - v[0]), a, b, phi)
            ends = [base, base, base]
        else:
            ends = [_run(v, np.full(n, x), np.full(n, y), a, b, phi) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))]
        flat = np.concatenate([np.concatenate(e) for e in ends])
        return pdf[part].iloc[:1].assign(first=first, ends=[list(flat)])

    ps = ", ".join(f"`{c}` {fields[c]}" for c in part)
    long_rows = rows.where(F.col("_long"))
    ends = pin(long_rows.select(*part, "step", "_v").groupBy(*part).applyInPandas(
        summarise, f"{ps}, first boolean, ends array<double>"))

    def chain(pdf):
        pdf = pdf.sort_values("_lane")
        state, starts = None, []
        for first, e in zip(pdf["first"], pdf["ends"]):
            e = np.asarray(e, float).reshape(3, 2, n)
            starts.append([] if state is None else list(np.concatenate(state)))
            if first:
                state = (e[0, 0], e[0, 1])
            else:
                lv, tr = state
                state = tuple(e[0, k] + (e[1, k] - e[0, k]) * lv + (e[2, k] - e[0, k]) * tr for k in range(2))
        return pdf[part].assign(start=starts)

    starts = ends.groupBy(key).applyInPandas(chain, f"{ps}, start array<double>")
    placed = lanes.attach(rows, starts, part)

    def resume(pdf):
        s = pdf["start"].iloc[0]
        if s is None or len(s) == 0:
            return walk(pdf)
        s = np.asarray(s, float).reshape(2, n)
        return walk(pdf, (s[0], s[1]))

    return placed.select(*part, *[c for c in keep if c not in part], "start").groupBy(*part).applyInPandas(resume, schema)


def holt_forecast(states: DataFrame, index: int, phi: float, ahead: int) -> Column:
    """Forecast ``ahead`` steps from the state before the row; the last value while the trend is unknown."""
    damp = sum(phi ** i for i in range(1, ahead + 1))
    return F.col("level")[index] + F.coalesce(F.nanvl(F.col("trend")[index], F.lit(None)), F.lit(0.0)) * damp


def holt_grid(states: DataFrame, key: str, h: int, configs=HOLT_GRID, last_train: DataFrame | None = None) -> DataFrame:
    """Mean absolute error of every configuration at horizon ``h``; fitted and forecast at the same h + 1.

    The truth of a forecast made at a step is the value h steps later.
    """
    long = states.select(key, "step", F.inline(F.array(*[
        F.struct(F.lit(i).alias("config"), holt_forecast(states, i, c[2], h + 1).alias("p"))
        for i, c in enumerate(configs)])))
    truth = states.select(key, (F.col("step") - h).alias("step"), F.col("_v").alias("y"))
    j = long.join(truth, [key, "step"])
    j = j.where(F.nanvl("p", F.lit(None)).isNotNull())
    return j.groupBy("config").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))


def theta_forecasts(states: DataFrame, key: str, ahead: int, index: int = 0, bound: int | None = None) -> DataFrame:
    """Smoothed level plus half the mean drift of everything seen before the row. The states are read three times and walked once."""
    states = pin(states.select(key, "step", "_v", F.col("level")[index].alias("_level")))
    first = states.groupBy(key).agg(F.min_by("_v", "step").alias("_first"))
    prev = states.select(key, (F.col("step") + 1).alias("step"), F.col("_v").alias("_last"))
    j = attach(states, first, key, "inner", bound).join(prev, [key, "step"], "left")
    drift = (F.col("_last") - F.col("_first")) / F.greatest(F.col("step") - 1, F.lit(1))
    p = F.when(F.col("step") >= 3, F.col("_level") + 0.5 * ahead * drift).otherwise(F.col("_last"))
    return j.select(key, "step", F.col("_v").alias("value"), p.alias("theta"))


# ---- per-series linear models from sums ---------------------------------------------------------------

def series_gram(train: DataFrame, key: str, xs: Sequence[str], y: str) -> DataFrame:
    """Per-series sums of products of (1, x..., y): what a least-squares fit needs, at any series length."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    known = train.where(F.col(y).isNotNull())
    for c in xs:
        known = known.where(F.col(c).isNotNull())
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return known.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("gram"))


def solve_series(gram: DataFrame, key: str, n_x: int, least: int, ridge: float = 0.0) -> DataFrame:
    """Coefficients (intercept first) per series with enough rows; ``ridge`` penalises standardised slopes."""
    import numpy as np

    def solve(batches):
        size = n_x + 2
        upper = np.triu_indices(size)
        for pdf in batches:
            out = []
            for g, n in zip(pdf["gram"], pdf["n"]):
                m = np.zeros((size, size))
                m[upper] = np.asarray(g, float)
                m = m + np.triu(m, 1).T
                mean = m[0, 1:] / n
                cov = m[1:, 1:] - n * np.outer(mean, mean)
                sx, sxy = cov[:-1, :-1], cov[:-1, -1]
                scale = np.sqrt(np.maximum(np.diag(sx) / n, 0.0))
                scale[scale < 1e-12] = 1.0
                z = sx / np.outer(scale, scale)
                w = np.linalg.lstsq(z + ridge * np.eye(n_x), sxy / scale, rcond=1e-10)[0] / scale
                out.append([float(mean[-1] - w @ mean[:-1]), *w.tolist(), float(mean[:-1].mean())])
            yield pdf[[key]].assign(coef=out)

    kind = dict(gram.dtypes)[key]
    return gram.where(F.col("n") >= least).select(key, "n", "gram").mapInPandas(solve, f"`{key}` {kind}, coef array<double>")


def apply_series(rows: DataFrame, coef: DataFrame, key: str, xs: Sequence[str], fallback: Column, name: str,
                 bound: int | None = None) -> DataFrame:
    """Prediction of the series' own model, the fallback where a series has none."""
    j = attach(rows, coef, key, bound=bound)
    fill = F.col("coef")[len(xs) + 1]
    p = F.col("coef")[0]
    for i, x in enumerate(xs):
        p = p + F.col("coef")[i + 1] * F.coalesce(F.col(x).cast("double"), fill)
    return j.withColumn(name, F.coalesce(p, fallback)).drop("coef")


# ---- ensembles, bands, coherence, back-tests ----------------------------------------------------------

def ensemble(legs: Sequence[str], how: str, weights: Sequence[float] | None = None) -> Column:
    """Mean, median or weighted mean over the legs that are present in the row."""
    cols = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in legs]
    known = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(known)
    if how == "mean":
        return F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / n)
    if how == "median":
        at = lambda i: F.try_element_at(known, F.greatest(i.cast("int"), F.lit(1)))
        return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)
    w = sum((F.when(c.isNotNull(), F.lit(float(x))).otherwise(0.0) for c, x in zip(cols, weights)), F.lit(0.0))
    v = sum((F.coalesce(c * float(x), F.lit(0.0)) for c, x in zip(cols, weights)), F.lit(0.0))
    return F.when(w > 0, v / w)


def leg_sums(rows: DataFrame, legs: Sequence[str], y: str) -> dict:
    """Per-leg errors and the legs' Gram matrix: a handful of numbers for the weights."""
    known = rows.where(F.col(y).isNotNull())
    for c in legs:
        known = known.where(F.col(c).isNotNull())
    pairs = [(i, j) for i in range(len(legs)) for j in range(i, len(legs))]
    return known.agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(c) - F.col(y))).alias(f"e{i}") for i, c in enumerate(legs)],
                     *[F.sum(F.col(legs[i]) * F.col(legs[j])).alias(f"g{i}_{j}") for i, j in pairs],
                     *[F.sum(F.col(c) * F.col(y)).alias(f"b{i}") for i, c in enumerate(legs)]).first().asDict()


def inverse_error_weights(sums: dict, k: int) -> list[float]:
    w = [1.0 / max(sums[f"e{i}"], 1e-6) for i in range(k)]
    return [x / sum(w) for x in w]


def stacked_weights(sums: dict, k: int) -> list[float]:
    """Non-negative least squares on the Gram matrix: the best of all subsets of legs, normalised to one."""
    import itertools
    import numpy as np
    g = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([sums[f"b{i}"] for i in range(k)])
    best, pick = np.inf, np.ones(k)
    for size in range(1, k + 1):
        for on in itertools.combinations(range(k), size):
            ix = list(on)
            w = np.linalg.lstsq(g[np.ix_(ix, ix)], b[ix], rcond=None)[0]
            if (w >= -1e-12).all():
                full = np.zeros(k)
                full[ix] = np.maximum(w, 0)
                loss = full @ g @ full - 2 * b @ full
                if loss < best - 1e-12:
                    best, pick = loss, full
    return [float(x) for x in pick / pick.sum()]


def conformal_band(long: DataFrame, by: Sequence[str], bound: int | None = None, coverage: float = 0.8) -> DataFrame:
    """Residual quantiles on train, widened on val so that ``coverage`` of val rows fall inside."""
    resid = long.where(F.col("y").isNotNull() & F.col("p").isNotNull()).withColumn("_e", F.col("y") - F.col("p"))
    tail = (1 - coverage) / 2
    edge = quantiles(resid.where("split = 'train'"), by, "_e", {"lo_e": tail, "hi_e": 1 - tail}, bound)
    val = resid.where("split = 'val'").join(F.broadcast(edge), list(by)).withColumn(
        "_c", F.greatest(F.col("lo_e") - F.col("_e"), F.col("_e") - F.col("hi_e")))
    q = quantiles(val, by, "_c", {"widen": coverage}, bound)
    return edge.join(q, list(by)).select(*by, (F.col("lo_e") - F.col("widen")).alias("lo"), (F.col("hi_e") + F.col("widen")).alias("hi"),
                                         "widen")


def pair_codes(sbp="sbp", dbp="dbp", reference="pp_ref", bound_col="pp_abs_dev_p99") -> Column:
    """Codes of what is wrong with a forecast pair; a check without its reference is skipped, not passed."""
    s, d = F.col(sbp), F.col(dbp)
    pp = s - d
    missing = s.isNull() | d.isNull() | F.isnan(s) | F.isnan(d)
    far = F.abs(pp - F.col(reference)) > F.col(bound_col)
    codes = F.array_compact(F.array(
        F.when(pp <= 0, "inverted"), F.when((pp > 0) & (pp < MIN_PULSE_PRESSURE), "below_pp_floor"),
        F.when(~s.between(*RANGES["sbp"]), "sbp_out_of_range"), F.when(~d.between(*RANGES["dbp"]), "dbp_out_of_range"),
        F.when(F.coalesce(far, F.lit(False)), "pp_far_from_baseline")))
    return F.when(missing, F.array(F.lit("leg_missing"))).otherwise(codes)


def pair_report(rows: DataFrame, by: Sequence[str], codes="codes", sbp="sbp", dbp="dbp") -> DataFrame:
    pp = F.col(sbp) - F.col(dbp)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.size(codes) > 0).alias("n_violations"),
        (F.count_if(F.size(codes) > 0) / F.count("*")).alias("violation_rate"), F.min(pp).alias("pp_min"),
        F.max(pp).alias("pp_max"), F.count_if(pp <= 0).alias("n_inverted"),
        F.count_if((pp > 0) & (pp < MIN_PULSE_PRESSURE)).alias("n_below_floor"))


def pair_reasons(rows: DataFrame, codes="codes") -> DataFrame:
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def backtest(long: DataFrame, by: Sequence[str], warm: int) -> DataFrame:
    """Error per horizon after warm-up, reported as steps ahead."""
    rows = long.where((F.col("step") >= warm) & F.col("y").isNotNull() & F.col("p").isNotNull())
    e = F.abs(F.col("y") - F.col("p"))
    return rows.groupBy(*by, (F.col("h") + 1).alias("steps_ahead")).agg(
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg((e <= 10).cast("double")).alias("within_10"))


def win_rates(errors: DataFrame, key: str, leader: str) -> DataFrame:
    """Share of entities whose mean error is below the leader's. ``errors``: key, model, row id, e."""
    per = errors.groupBy(key, "model").agg(F.avg("e").alias("e"))
    ref = per.where(F.col("model") == leader).select(key, F.col("e").alias("ref"))
    return per.join(ref, key).groupBy("model").agg(F.avg((F.col("e") < F.col("ref")).cast("double")).alias("win_rate"))


def tie_set(long: DataFrame, leader: str, row_keys: Sequence[str], key: str, draws: int = 200) -> DataFrame:
    """Models whose paired error difference to the leader cannot be told from zero, with their win rate."""
    from seriesloom.operators.metrics import paired
    rows = long.where(F.col("y").isNotNull() & F.col("p").isNotNull()).withColumn("e", F.abs(F.col("y") - F.col("p")))
    ref = rows.where(F.col("model") == leader).select(*row_keys, F.col("e").alias("ref"))
    j = rows.join(ref, list(row_keys))
    d = paired(j, ["model"], "e", "ref", list(row_keys), draws)
    return d.withColumn("ties_leader", (F.col("lo") <= 0) & (F.col("hi") >= 0) | (F.col("model") == leader)).join(
        win_rates(rows, key, leader), "model")


def cheapest_tied(ties: DataFrame, val_mae: DataFrame, cost: dict[str, int]) -> DataFrame:
    """The cheapest member of the tie set; equal cost goes to the lower validation error, then the name."""
    rank = F.coalesce(F.element_at(F.create_map(*[x for m, c in cost.items() for x in (F.lit(m), F.lit(c))]), F.col("model")), F.lit(1))
    return ties.where("ties_leader").join(val_mae, "model").withColumn("cost", rank).orderBy("cost", "mae", "model").limit(1)


def tuning_comparison(default: DataFrame, tuned: DataFrame) -> DataFrame:
    """Validation error of defaults against tuned settings; a gain counts beyond the interval width."""
    by = ["signal", "model"]
    a = default.groupBy(*by).agg(F.avg("mae").alias("mae_default"), F.avg(F.col("hi") - F.col("lo")).alias("width"))
    b = tuned.groupBy(*by).agg(F.avg("mae").alias("mae_tuned"))
    gain = F.col("mae_default") - F.col("mae_tuned")
    return a.join(b, by, "left").select(*by, "mae_default", "mae_tuned", gain.alias("gain"), (gain > F.col("width")).alias("beyond_ci"))
