"""Sessions -> panel: cohort, step index, cadence, clinical columns, splits, folds, thinning, placeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.config import Config, GAP_FIRST, GAP_HIGH, GAP_LOW
from seriesloom.functions.expr import age_band, clip, day_gap, entity_split, half_even
from seriesloom.functions.lanes import Lanes, lay_out
from seriesloom.functions.skew import attach


def eligible(sessions: DataFrame, key="series_id", ts="ts", min_sessions=60, min_span_days=120) -> DataFrame:
    """Series with enough rows over a long enough span, with their size."""
    g = sessions.groupBy(key).agg(F.count("*").alias("n_sessions"),
                                  day_gap(F.max(ts), F.min(ts)).alias("span_days"))
    return g.where((F.col("n_sessions") >= min_sessions) & (F.col("span_days") >= min_span_days))


def largest(cohort: DataFrame, k: int, key="series_id") -> DataFrame:
    """The k largest series; ties by the id as text."""
    return cohort.orderBy(F.col("n_sessions").desc(), F.col(key).cast("string")).limit(k)


def admit(sessions: DataFrame, config: Config, key="series_id", ts="ts", bound: int | None = None) -> DataFrame:
    """Rows of the cohort; ``max_entities``, off by default, keeps only that many of the largest series."""
    cohort = eligible(sessions, key, ts, config.min_sessions, config.min_span_days)
    if config.max_entities:
        cohort = largest(cohort, config.max_entities, key)
    return attach(sessions, cohort.select(key), key, "left_semi", bound)


def raw_gap(lanes: Lanes, ts="ts", fractional=False) -> Column:
    """Days since the previous row; null on the first row, never clipped."""
    previous = F.lag(ts).over(lanes.window)
    if fractional:
        micros = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(previous.cast("timestamp")))
        return micros / F.lit(86_400_000_000.0)
    return day_gap(ts, previous).cast("double")


def model_gap(gap, first=GAP_FIRST, lo=GAP_LOW, hi=GAP_HIGH) -> Column:
    """The model's gap: a first-row value, then optional bounds."""
    return clip(F.coalesce(F.col(gap), F.lit(float(first))), lo, hi)


def attach_cadence(lanes: Lanes, df: DataFrame, ts="ts") -> DataFrame:
    return (df.withColumn("days_since_last_raw", raw_gap(lanes, ts))
            .withColumn("days_since_last", model_gap("days_since_last_raw")))


def clinical(df: DataFrame, ts="ts") -> DataFrame:
    """Pulse pressure, mean pressure, weekday, sex, diabetes flag and age band."""
    male = F.coalesce(F.upper("gender").startswith("M"), F.lit(False))
    return df.select(
        "*", (F.col("sbp") - F.col("dbp")).alias("pulse_pressure"),
        (F.col("dbp") + (F.col("sbp") - F.col("dbp")) / 3.0).alias("map_est"),
        F.weekday(F.col(ts)).alias("dow"),
        F.when(F.weekday(F.col(ts)) >= 5, 1).otherwise(0).alias("is_weekend"),
        male.cast("int").alias("is_male"), F.coalesce(F.col("DM"), F.lit(0)).cast("int").alias("is_dm"),
        age_band("age").alias("age_band"))


def split_edges(lanes: Lanes, df: DataFrame, test_frac=0.2, val_frac=0.2) -> DataFrame:
    """``split`` by the tail of each series: train, then val, then test."""
    sized = lanes.whole(df, _last=F.max("step"))
    last = F.col("_last").cast("double")
    test_edge = half_even(last * F.lit(1 - test_frac))
    val_edge = half_even(last * F.lit(1 - test_frac - val_frac))
    return sized.withColumn("split", F.when(F.col("step") > test_edge, "test")
                            .when(F.col("step") > val_edge, "val").otherwise("train")).drop("_last")


def tail_split(lanes: Lanes, df: DataFrame, test_frac=0.2) -> DataFrame:
    """Two-way split: everything after the edge is the test tail."""
    sized = lanes.whole(df, _last=F.max("step"))
    edge = half_even(F.col("_last").cast("double") * F.lit(1 - test_frac))
    return sized.withColumn("part", F.when(F.col("step") > edge, "test").otherwise("train")).drop("_last")


def add_splits(lanes: Lanes, df: DataFrame, config: Config) -> DataFrame:
    out = split_edges(lanes, df, config.test_frac, config.val_frac)
    return out.withColumn("patient_split",
                          entity_split(lanes.key[0], config.holdout_frac, config.split_salt))


def build_panel(sessions: DataFrame, static: DataFrame | None, config: Config, key="series_id", ts="ts",
                tie: Sequence[str] = (), reach: int = 30, bound: int | None = None) -> Lanes:
    """The panel as lanes; ``lanes.df`` has steps, cadence, clinical columns and splits."""
    rows = admit(sessions, config, key, ts, bound)
    if static is not None:
        rows = attach(rows, static, key, bound=bound)
    lanes = lay_out(rows, [key], [ts, *tie], reach=reach, bound=bound)
    df = attach_cadence(lanes, lanes.df, ts)
    if static is not None:
        df = clinical(df, ts)
    lanes.df = add_splits(lanes, df, config)
    return lanes


def percent_rank(lanes: Lanes, df: DataFrame, name="q") -> DataFrame:
    """Position inside the series as (row number) / (row count)."""
    return lanes.whole(df, _n=F.count("*")).withColumn(name, (F.col("step") + 1) / F.col("_n")).drop("_n")


def inner_split(lanes: Lanes, df: DataFrame, edge=0.75) -> DataFrame:
    return percent_rank(lanes, df, "_q").withColumn(
        "inner", F.when(F.col("_q") <= edge, "fit").otherwise("check")).drop("_q")


def fold_edges(n_folds: int) -> list[float]:
    """Evenly spaced from 0.4 to 1, one more than folds."""
    step = (1.0 - 0.4) / n_folds
    return [0.4 + i * step for i in range(n_folds)] + [1.0]


def folds(ranked: DataFrame, n_folds: int, q="q") -> DataFrame:
    """Expanding folds: one row per (row, fold) it takes part in, with ``role`` train or valid."""
    e = fold_edges(n_folds)
    member = F.array_compact(F.array(*[
        F.when(F.col(q) <= F.lit(e[i + 1]),
               F.struct(F.lit(i).alias("fold"),
                        F.when(F.col(q) <= F.lit(e[i]), "train").otherwise("valid").alias("role")))
        for i in range(n_folds)]))
    return ranked.select("*", F.inline(member))


def thin(lanes: Lanes, fracs: Sequence[float], seed: int, order: Sequence[str]) -> DataFrame:
    """Drop ``round(frac * (n - 2))`` interior rows per series and fraction; endpoints always stay.

    Returns one copy of the panel per fraction with ``drop_frac``, the old ``step`` as ``old_step`` and
    a renumbered ``step``. Rows are chosen by the md5 of (series, step, seed), the lowest first.
    """
    key = lanes.key
    sized = lanes.done(lanes.whole(lanes.df, _n=F.count("*")))
    inner = (F.col("step") > 0) & (F.col("step") < F.col("_n") - 1)
    drawn = (sized.where(inner).select(*key, F.col("step").alias("old_step"))
             .withColumn("_draw", F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.col("old_step").cast("string"), F.lit(str(seed))).cast("binary"))))
    chosen = lay_out(drawn, key, ["_draw", "old_step"])
    ranks = chosen.done(chosen.df).select(*key, "old_step", F.col("step").alias("_rank"))
    each = (sized.withColumnRenamed("step", "old_step").join(ranks, [*key, "old_step"], "left")
            .withColumn("drop_frac", F.explode(F.array(*[F.lit(float(f)) for f in fracs]))))
    n_drop = F.when(F.col("_n") <= 3, 0).otherwise(half_even(F.col("drop_frac") * (F.col("_n") - 2)))
    kept = each.where(F.col("_rank").isNull() | (F.col("_rank") >= n_drop)).drop("_rank", "_n")
    again = lay_out(kept, [*key, "drop_frac"], list(order))
    return again.done(again.df)


def usual_gap(gap="days_since_last_raw") -> Column:
    """The median gap of a series in days, 2 where that is zero or unknown (an aggregate)."""
    return F.coalesce(F.nullif(F.percentile(gap, F.lit(0.5)), F.lit(0.0)), F.lit(2.0))


def placeholders(panel: DataFrame, key="series_id", ts="ts", as_of=None, carry: Sequence[str] = ()) -> DataFrame:
    """One future row per series, vitals null.

    It stands at ``as_of`` (at least one day after the last row), or one median gap after the last row.
    Gaps are whole days, so ``percentile`` holds at most one entry per distinct day count.
    """
    usual = usual_gap()
    last = panel.groupBy(key).agg(F.max(ts).alias("_last"), F.max("step").alias("_step"),
                                  usual.alias("median_gap"), *[F.max_by(c, "step").alias(c) for c in carry])
    day = F.to_date("_last")
    at = (F.greatest(F.to_date(F.lit(as_of)), F.date_add(day, 1)) if as_of
          else F.date_add(day, F.floor("median_gap").cast("int")))
    return last.select(key, at.cast(panel.schema[ts].dataType).alias(ts), (F.col("_step") + 1).alias("step"),
                       "median_gap", *carry)


def with_placeholders(panel: DataFrame, key="series_id", ts="ts", as_of=None,
                      carry: Sequence[str] = ()) -> DataFrame:
    """Panel rows plus one placeholder per series, so that lag 1 of the placeholder is the newest row."""
    return (panel.withColumn("is_placeholder", F.lit(False))
            .unionByName(placeholders(panel, key, ts, as_of, carry).drop("median_gap")
                         .withColumn("is_placeholder", F.lit(True)), allowMissingColumns=True))


def schedule(base: DataFrame, horizons: int, gap="median_gap", ts="ts", step="step") -> DataFrame:
    """One future row per horizon: ``ts`` moved by the series' usual gap, ``step + h + 1``."""
    ahead = F.explode(F.sequence(F.lit(0), F.lit(horizons - 1))).alias("h")
    out = base.select("*", ahead)
    days = half_even(F.col(gap) * (F.col("h") + 1), 1)
    return out.select("*", days.alias("days_ahead"),
                      F.date_add(F.to_date(ts), F.floor(days).cast("int")).alias("target_ts"),
                      (F.col(step) + F.col("h") + 1).alias("target_step"))


def engine_columns(lanes: Lanes, df: DataFrame, offset: int = 0, pulse="pulse", weight="weight") -> DataFrame:
    """What the rule engine reads from earlier rows: weight change, recent fast pulse, last emergency."""
    w = lanes.window
    return df.select(
        "*", (F.col("step") + F.lit(offset)).alias("engine_step"),
        F.coalesce(F.col(weight) - F.lag(weight).over(w), F.lit(0.0)).alias("weight_delta_24h"),
        F.coalesce(F.lag(pulse).over(w) > 100, F.lit(False)).alias("hr_high_recent"),
        F.coalesce(F.lag("sbp").over(w) >= 180, F.lit(False)).alias("prev_emergency"))


def run_length(lanes: Lanes, df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Length of the current unbroken run of rows where ``condition`` holds (0 where it does not)."""
    holds = F.coalesce(condition, F.lit(False))
    marked = df.withColumn("_break", F.when(~holds, F.col("step")))
    ran = lanes.running(marked, _at=("max", F.col("_break")))
    return ran.withColumn(name, (F.col("step") - F.coalesce(F.col("_at"), F.lit(-1))).cast("long")
                          ).drop("_break", "_at")


def brady_run(lanes: Lanes, df: DataFrame, pulse="pulse", dizzy="dizziness") -> DataFrame:
    calm = F.col(pulse).between(40, 49) & (F.coalesce(F.col(dizzy).cast("int"), F.lit(0)) == 0)
    return run_length(lanes, df, "brady_run_len", calm)
