"""Strictly causal features: a feature at step t reads steps up to t-1 only.

Every frame ends one row before the current one. The whole set is built over one (partition, order),
so Spark plans one shuffle, one sort and one chain of window operators for any number of features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.config import Config
from seriesloom.functions.expr import first_of, ratio
from seriesloom.functions.lanes import Lanes
from seriesloom.operators.dense import REACH, Dense
from seriesloom.operators.running_median import expanding_median

EWM_BLOCK = 400.0


def ewm_name(signal: str, alpha: float) -> str:
    return f"{signal}_ewm{int(round(alpha * 100)):02d}"


def enough(count: Column, least: int, value: Column) -> Column:
    return F.when(count >= least, value)


def rolling(lanes: Lanes, value: Column, w: int, least: int, agg) -> Column:
    frame = lanes.rows(-w, -1)
    return enough(F.count(value).over(frame), least, agg(value).over(frame))


def rolling_slope(lanes: Lanes, value: Column, w: int) -> Column:
    """OLS slope over the w previous rows; null unless all w are present."""
    frame = lanes.rows(-w, -1)
    slope = F.regr_slope(value.cast("double"), F.col("step").cast("double")).over(frame)
    return F.when(F.count(value).over(frame) == w, slope)


def level_columns(lanes: Lanes, s: str, config: Config) -> list[Column]:
    """Lags, rolling moments, ranges, slopes and the first difference of one signal."""
    v, w1 = F.col(s).cast("double"), lanes.window
    out = [F.lag(v, k).over(w1).alias(f"{s}_lag{k}") for k in config.lags]
    for w in config.windows:
        least = max(2, w // 3)
        lo, hi = rolling(lanes, v, w, least, F.min), rolling(lanes, v, w, least, F.max)
        out += [rolling(lanes, v, w, least, F.avg).alias(f"{s}_mean{w}"),
                rolling(lanes, v, w, least, F.stddev_samp).alias(f"{s}_std{w}"),
                lo.alias(f"{s}_min{w}"), hi.alias(f"{s}_max{w}"), (hi - lo).alias(f"{s}_range{w}"),
                rolling_slope(lanes, v, w).alias(f"{s}_slope{w}")]
    return out + [(F.lag(v, 1).over(w1) - F.lag(v, 2).over(w1)).alias(f"{s}_d1")]


def add_baseline(lanes: Lanes, df: DataFrame, prefix: str, value: Column, least: int = 5) -> DataFrame:
    """Expanding mean and deviation of the rows before this one."""
    names = [c for c in df.columns]
    m = lanes.moments(df, "_x", value)
    return m.select(*names, enough(F.col("_x_n"), least, F.col("_x_mean")).alias(f"{prefix}_base_mean"),
                    enough(F.col("_x_n"), least, F.col("_x_std")).alias(f"{prefix}_base_std"))


def add_ewma(lanes: Lanes, df: DataFrame, values: dict[str, Column], alphas: Sequence[float]) -> DataFrame:
    """Exponential smoothing of the previous rows: ``ewm_name(signal, alpha)`` for every pair.

    The recurrence y <- a*y + (1-a)*x is a sum of x weighted by products of a. With L = -sum(ln a) the sum
    is cut into blocks of L; a term two blocks back weighs less than e-37 of the result, so the running
    sum of a row's block plus the total of the block before is all that counts. A null leaves y as it is
    but ages it: g rows after the last value, a = (1-alpha)^g / ((1-alpha)^g + alpha).
    """
    names = df.columns
    alphas = sorted(alphas, reverse=True)        # the first one ages fastest and cuts the blocks
    if math.log(1 - alphas[-1]) / math.log(1 - alphas[0]) * EWM_BLOCK < 37:
        raise ValueError("alphas too far apart for one set of blocks")
    x = df.select("*", *[F.lag(v.cast("double")).over(lanes.window).alias(f"_u_{s}") for s, v in values.items()])
    x = lanes.running(x, last=-1, **{f"_seen_{s}": ("max", F.when(F.col(f"_u_{s}").isNotNull(), F.col("step")))
                                     for s in values})
    grown, cost = [], {}
    for s in values:
        age = F.coalesce((F.col("step") - F.col(f"_seen_{s}")).cast("double"), F.lit(0.0))
        for i, a in enumerate(alphas):
            power = F.least(age * F.lit(-math.log(1 - a)), F.lit(500.0))
            g = F.when(F.col(f"_seen_{s}").isNotNull(), F.lit(a) * F.exp(power))
            grown.append(g.alias(f"_g{i}_{s}"))
            cost[f"_L{i}_{s}"] = ("sum", F.when(F.col(f"_u_{s}").isNotNull(),
                                                F.coalesce(F.log1p(F.col(f"_g{i}_{s}")), F.lit(0.0))))
    x = lanes.running(x.select("*", *grown), **cost)
    x = x.select("*", *[F.floor(F.col(f"_L0_{s}") / EWM_BLOCK).alias(f"_b_{s}") for s in values])
    made = []
    for s in values:
        x = _ewma_blocks(lanes, x, s, len(alphas))
        for i, a in enumerate(alphas):
            level = F.col(f"_L{i}_{s}")
            here = F.col(f"_s{i}") * F.exp(F.col(f"_r{i}") - level)
            past = F.col(f"_p{i}") * F.exp(F.col(f"_q{i}") - level)
            x = x.withColumn(ewm_name(s, a), F.when(here.isNull() | past.isNull(), F.coalesce(here, past))
                             .otherwise(here + past))
            x = _ewma_carry(lanes, x, f"_L{i}_{s}", ewm_name(s, a))
            made.append(ewm_name(s, a))
        x = x.drop(*[f"_{c}{i}" for c in "srpqw" for i in range(len(alphas))])
    return x.select(*names, *made)


def _ewma_blocks(lanes: Lanes, x: DataFrame, s: str, n: int) -> DataFrame:
    """Per alpha: running sum ``_s`` and origin ``_r`` of the row's block, ``_p`` and ``_q`` of the one before."""
    block = f"_b_{s}"
    so_far = (Window.partitionBy(*lanes.part, block).orderBy(*lanes.order)
              .rowsBetween(Window.unboundedPreceding, 0))
    # L never falls inside a series, so its running minimum is its value at the start of the block.
    x = x.select("*", *[F.min(lanes.own(F.col(f"_L{i}_{s}"))).over(so_far).alias(f"_r{i}") for i in range(n)])
    weight = []
    for i in range(n):
        g = F.col(f"_g{i}_{s}")
        fresh = F.when(g.isNull(), F.lit(1.0)).otherwise(g / (1 + g))
        weight.append((fresh * F.col(f"_u_{s}") * F.exp(F.col(f"_L{i}_{s}") - F.col(f"_r{i}"))).alias(f"_w{i}"))
    x = x.select("*", *weight)
    x = x.select("*", *[F.sum(lanes.own(F.col(f"_w{i}"))).over(so_far).alias(f"_s{i}") for i in range(n)])
    back = Window.partitionBy(*lanes.part).orderBy(block).rangeBetween(-1, -1)
    own_step = lanes.own(F.col("step"))
    return x.select("*", *[F.max_by(f"_s{i}", own_step).over(back).alias(f"_p{i}") for i in range(n)],
                    *[F.min(f"_r{i}").over(back).alias(f"_q{i}") for i in range(n)])


def _ewma_carry(lanes: Lanes, x: DataFrame, level: str, name: str) -> DataFrame:
    """Add what earlier lanes of a long series left behind, aged by the L in between."""
    if not lanes.split:
        return x
    part = list(lanes.part)
    ends = lanes.summary(x, lanes.part, F.max_by(name, "step").alias("_y"), F.max(level).alias("_end"))

    def fold(pdf):
        pdf = pdf.sort_values("_lane")
        y, at, ys, ats = None, None, [], []
        for own, end in zip(pdf["_y"], pdf["_end"]):
            ys.append(y)
            ats.append(at)
            if end == end and end is not None:
                y = (0.0 if own != own or own is None else own) + (0.0 if y is None else y * math.exp(at - end))
                at = end
        return pdf[part].assign(_y_in=ys, _at_in=ats).astype({"_y_in": float, "_at_in": float})

    fields = [f for f in ends.schema.fields if f.name in lanes.part]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _y_in double, _at_in double"
    folded = ends.select(*lanes.part, "_y", "_end").groupBy(*lanes.key).applyInPandas(fold, schema)
    clean = folded.select(*lanes.part, F.nanvl("_y_in", F.lit(None)).alias("_y_in"),
                          F.nanvl("_at_in", F.lit(None)).alias("_at_in"))
    y = lanes.attach(x, clean, lanes.part)
    past = F.col("_y_in") * F.exp(F.col("_at_in") - F.coalesce(F.col(level), F.col("_at_in")))
    both = F.when(past.isNull() | F.col(name).isNull(), F.coalesce(F.col(name), past)).otherwise(F.col(name) + past)
    return y.withColumn(name, both).drop("_y_in", "_at_in")


def weight_columns(lanes: Lanes, df: DataFrame, weight="weight") -> DataFrame:
    """Previous weight, its slope over 24 rows and its distance from the running median.

    All null for a series with at most three weights.
    """
    names = df.columns
    x = lanes.whole(df, _known=F.count(weight))
    x = expanding_median(lanes, x, weight, "_median", least=5)
    ok = F.col("_known") > 3
    lag1 = F.lag(F.col(weight).cast("double")).over(lanes.window)
    x = x.select("*", lag1.alias("_lag1"), rolling_slope(lanes, F.col(weight), 24).alias("_slope"))
    return x.select(*names, F.when(ok, F.col("_lag1")).alias("weight_lag1"),
                    F.when(ok, F.col("_slope")).alias("weight_slope24"),
                    F.when(ok, F.col("_lag1") - F.col("_median")).alias("weight_delta_base"))


def contrast_columns(s: str, config: Config) -> list[Column]:
    """Z-score, momentum, excess over the personal mean, volatility ratio, smoothing residual."""
    c = lambda suffix: F.col(f"{s}_{suffix}")
    return [ratio(c("lag1") - c("base_mean"), c("base_std")).alias(f"{s}_z"),
            (c("mean3") - c("mean14")).alias(f"{s}_mom_3_14"),
            (c("mean7") - c("base_mean")).alias(f"{s}_excess_base"),
            ratio(c("std3"), c("std14")).alias(f"{s}_vol_ratio"),
            (c("lag1") - F.col(ewm_name(s, max(config.alphas)))).alias(f"{s}_ewm_resid")]


def dense_levels(one: Dense, s: str, config: Config) -> list[Column]:
    """:func:`level_columns` made in one pass."""
    out = one.level(s, F.col(s), config.lags, config.windows)
    first, second = (F.col(f"{s}_lag{k}") if k in config.lags else one.lag(s, F.col(s), k, f"_{s}_lag{k}") for k in (1, 2))
    return out + [(first - second).alias(f"{s}_d1")]


HISTORY = ("heart_rate", "took_all_meds", "missed_antihypertensive", "sym_any", "sym_count")
TODAY = ("took_all_meds", "missed_antihypertensive")


def raw_symptoms(columns: Sequence[str]) -> list[str]:
    derived = ("_lag1", "_rate30", "_mean7", "_mean30")
    return [c for c in columns if c.startswith("sym_") and not c.endswith(derived)]


def target_columns(lanes: Lanes, signals: Sequence[str], horizons: Sequence[int]) -> list[Column]:
    """``y_<signal>_h<h>`` is the value h rows ahead; h = 0 is the current row."""
    return [F.lead(F.col(s), h).over(lanes.window).alias(f"y_{s}_h{h}") if h else F.col(s).alias(f"y_{s}_h0")
            for s in signals for h in horizons]


def build_features(lanes: Lanes, config: Config = Config(), df: DataFrame | None = None, dense: bool = False, smooth: bool = True) -> DataFrame:
    """The feature frame: panel columns, features and targets. Echo rows are gone on return.

    ``dense`` makes all lags, rolling statistics and smoothed levels in one pass: faster for callers that read most of them,
    slower for those that read a few. Without ``smooth`` it leaves smoothing to windows: the values are then those of the
    windows to the last bit, as callers that hash them need.
    """
    return lanes.done(with_features(lanes, config, df, dense, smooth))


def with_features(lanes: Lanes, config: Config = Config(), df: DataFrame | None = None, dense: bool = False, smooth: bool = True) -> DataFrame:
    """The feature frame in its lanes, echo rows included, for more windows over it."""
    df = lanes.df if df is None else df
    one = Dense() if dense else None
    have = set(df.columns)
    symptoms = raw_symptoms(df.columns)
    pair = {"sbp", "dbp"} <= have and set(config.signals) == {"sbp", "dbp"}
    for s in config.signals:
        df = add_baseline(lanes, df, s, F.col(s))
    smoothed = len(df.columns)
    smooth = smooth and dense and not lanes.split
    if not smooth:
        df = add_ewma(lanes, df, {s: F.col(s) for s in config.signals}, config.alphas)
    if pair:
        df = add_baseline(lanes, df, "_pp", F.col("sbp") - F.col("dbp"))
    if "heart_rate" in have:
        df = add_baseline(lanes, df, "_hr", F.col("heart_rate"))
    if "weight" in have:
        df = weight_columns(lanes, df)
    lag = lambda name, source, v, k=1: one.lag(source, v, k, name) if dense else F.lag(v, k).over(lanes.window).alias(name)
    mean = lambda name, source, v, w, least: one.mean(source, v, w, least, name) if dense else rolling(lanes, v, w, least, F.avg).alias(name)
    made: list[Column] = []
    for s in config.signals:
        made += dense_levels(one, s, config) if dense else level_columns(lanes, s, config)
    if "days_since_last" in have:
        made.append(mean("gap_mean24", "days_since_last", F.col("days_since_last"), 24, 4))
    if pair:
        pp = (F.col("sbp") - F.col("dbp")).cast("double")
        made += [lag("pp_lag1", "pp", pp), mean("pp_mean7", "pp", pp, 7, 3)]
    for c in (c for c in HISTORY if c in have):
        v = F.col(c).cast("double")
        made += [lag(f"{c}_lag1", c, v), mean(f"{c}_mean7", c, v, 7, 2), mean(f"{c}_mean30", c, v, 30, 5)]
    if "heart_rate" in have:
        hr, w = F.col("heart_rate").cast("double"), lanes.window
        first = F.col("heart_rate_lag1") if dense else F.lag(hr, 1).over(w)
        made.append((first - (one.lag("heart_rate", hr, 2, "_hr_lag2") if dense else F.lag(hr, 2).over(w))).alias("hr_d1"))
    made += [F.col(c).alias(f"adh_{c}_today") for c in TODAY if c in have]
    for c in symptoms:
        v = F.col(c).cast("double")
        if c not in HISTORY:
            made.append(lag(f"{c}_lag1", c, v))
        made.append(mean(f"{c}_rate30", c, v, 30, 5))
    targets = target_columns(lanes, [*symptoms, *config.signals], config.horizons)
    if dense:
        names = df.columns
        ahead = df.select("*", *targets)
        soft = [one.ewm(s, F.col(s), a, ewm_name(s, a)) for s in config.signals for a in sorted(config.alphas, reverse=True)] if smooth else []
        df = one.run(lanes, ahead).select(*names[:smoothed], *soft, *names[smoothed:], *made, *ahead.columns[len(names):])
    else:
        df = df.select("*", *made, *targets)

    late: list[Column] = []
    for s in config.signals:
        late += contrast_columns(s, config)
    if pair:
        late += [ratio(F.col("pp_lag1") - F.col("_pp_base_mean"), F.col("_pp_base_std")).alias("pp_z"),
                 ratio(F.col("sbp_lag1"), F.col("dbp_lag1")).alias("sbp_dbp_ratio")]
    if "heart_rate" in have:
        late += [ratio(F.col("heart_rate_lag1") - F.col("_hr_base_mean"), F.col("_hr_base_std")).alias("hr_z"),
                 ratio(F.col("heart_rate_lag1"), F.col("sbp_lag1")).alias("shock_index_lag1")]
    return df.select("*", *late).drop("_pp_base_mean", "_pp_base_std", "_hr_base_mean", "_hr_base_std")


# Columns a model never sees raw, and bookkeeping columns the frame keeps.
NOT_FEATURES = frozenset("""
    ts series_id patient_id gender step age_band split patient_split sbp dbp idwg weight sbp_post sbp_min
    sbp_drop uf_total temperature weightstart weightend dryweight n_meas pulse_pressure map_est DM keyindate
    datatime dow days_since_last_raw reading_age_days session_start session_end session_hours session_source
    first_dialysis_ts nadir_sbp map_drop idwg_rel uf_rate vintage_years heart_rate took_all_meds
    missed_antihypertensive sym_count sym_any sym_red_flag idh_kdoqi n_medications adherence_trait frailty
""".split())
LATENT = ("adherence_trait", "frailty")


def feature_names(df: DataFrame) -> list[str]:
    """Every numeric column that is neither bookkeeping, nor contemporaneous, nor a target."""
    numeric = ("byte", "short", "int", "bigint", "smallint", "tinyint", "float", "double")
    raw = set(raw_symptoms(df.columns))
    return [n for n, t in df.dtypes
            if t in numeric and n not in NOT_FEATURES and not n.startswith(("y_", "sym_mech_", "_"))
            and n not in raw]


def feature_group(name) -> Column:
    """Readable family of a feature name; the first matching rule wins."""
    c = F.col(name) if isinstance(name, str) else name
    signal = c.startswith("sbp_") | c.startswith("dbp_")
    base = F.regexp_replace(c, "^(sbp|dbp)_", "")
    on = lambda pattern: signal & base.rlike(pattern)
    return first_of(
        (on("^mom_"), "momentum contrast"), (on("^excess_base$"), "baseline excess"),
        (on("^vol_ratio$"), "volatility ratio"), (on("^ewm_resid$"), "ewma residual"),
        (on("^x_"), "interaction"), (on("^per_kg"), "size-normalised"), (on("^lag"), "lag"),
        (on("^(mean|std|min|max|range)"), "rolling moment"), (on("^slope"), "trend"), (on("^ewm"), "smoother"),
        (on("^base"), "personal baseline"), (on("^z$"), "personal z-score"), (on("^d1$"), "first difference"),
        (on("^dbp_ratio$"), "size-normalised"), (c.startswith("pp_"), "pulse-pressure dynamics"),
        (c.contains("_x_"), "interaction"), (c.startswith("weight"), "weight"),
        (c.rlike("^(hr_|heart_rate)") | (c == "shock_index_lag1"), "heart rate"),
        (c.startswith("sym_"), "symptom history"), (c.rlike("^(med_|on_)"), "medication class"),
        (c.startswith("adh_") | c.rlike("adherence|took_all_meds|missed_antihypertensive"), "adherence"),
        (c.rlike("^(has_|dx_|clin_)"), "diagnosed condition"), (c.isin("age", "is_male", "is_dm"), "static"),
        (c.isin("days_since_last", "gap_mean24", "is_weekend"), "cadence"), default="other")


def unpivot(df: DataFrame, columns: Sequence[str], name="feature", value="value", keep: Sequence[str] = ()) -> DataFrame:
    """Long form of numeric columns: one row per (row, column)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(pairs))


def feature_dictionary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature, group, signal and observed density from one aggregate."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in features])
    long = unpivot(one, features, "feature", "density")
    signal = F.when(F.col("feature").rlike("^(sbp|dbp|weight)"), F.split("feature", "_")[0]).otherwise("-")
    return long.select("feature", feature_group("feature").alias("group"), signal.alias("signal"), "density")
