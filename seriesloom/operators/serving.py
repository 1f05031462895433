"""Scoring requests as table jobs: validation, mapping to the panel, banners, tiers, chained scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.config import Config, RANGES, STALE_DAYS
from seriesloom.functions.expr import first_of, half_even
from seriesloom.functions.lanes import lay_out
from seriesloom.functions.skew import attach
from seriesloom.operators.rulebook import (CONDITIONS, MECHANISMS, MEDICATIONS, RED_FLAGS, SERVING_NAMES, SYMPTOMS)

# Bounds of a submitted reading and profile, and the three quadrature nodes with weights.
READING_BOUNDS = {"sbp": RANGES["sbp"], "dbp": RANGES["dbp"], "pulse": (20, 250), "weight": RANGES["weight"], "n_meas": (1, 10)}
PROFILE_BOUNDS = {"age": (18, 110), "provider_target": (80, 200), "missed_3d": (0, 3), "adherence_7d": (0.0, 1.0), "step_offset": (0, 100_000)}
Z80 = 1.2815515655446004
NODES = ((0.0, 2.0 / 3.0), (math.sqrt(3.0), 1.0 / 6.0), (-math.sqrt(3.0), 1.0 / 6.0))


def reading_errors(df: DataFrame, key="patient_id", date="date", bound: int | None = None) -> DataFrame:
    """Every submitted reading with the codes of what is wrong with it; an empty list is a valid row.

    Histories of any length are valid. ``bound`` is an upper bound of the rows of a key and date.
    """
    per_day = df.groupBy(key, date).agg(F.count("*").alias("_same_day"))
    d = attach(df, per_day, [key, date], bound=bound)
    have = set(df.columns)
    out = [F.when(F.col(date).isNull(), "unparseable_date"), F.when(F.col("_same_day") > 1, "duplicate_date"),
           F.when(F.col("sbp") - F.col("dbp") < 10, "pulse_pressure")]
    out += [F.when(~F.col(c).between(lo, hi), f"{c}_out_of_range") for c, (lo, hi) in {**READING_BOUNDS, **PROFILE_BOUNDS}.items()
            if c in have]
    for c, vocabulary in (("symptoms", SYMPTOMS), ("conditions", CONDITIONS), ("medications", MEDICATIONS)):
        if c in have:
            unknown = F.array_except(F.col(c), F.array(*[F.lit(v) for v in vocabulary]))
            out.append(F.when(F.size(unknown) > 0, f"unknown_{c}"))
    if {"is_pregnant", "is_male"} <= have:
        out.append(F.when((F.col("is_pregnant") == 1) & (F.col("is_male") == 1), "pregnant_and_male"))
    checked = d.withColumn("errors", F.array_compact(F.array(*out))).drop("_same_day")
    if {"hf_type", "conditions"} <= have:
        implied = F.when((F.col("hf_type") != "NONE") & ~F.array_contains("conditions", "has_hf"),
                         F.array_append("conditions", F.lit("has_hf"))).otherwise(F.col("conditions"))
        checked = checked.withColumn("conditions", implied)
    return checked


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def to_history(df: DataFrame) -> DataFrame:
    """Readings in the shape the models expect; what nobody collects stays null, never zero."""
    alias = F.create_map(*[x for s in SYMPTOMS for x in (F.lit(s), F.lit(SERVING_NAMES.get(s, s)))])
    known = [s for members in MECHANISMS.values() for s in members]
    present = F.array_intersect(F.transform("symptoms", lambda s: F.element_at(alias, s)), F.array(*[F.lit(k) for k in known]))
    has = lambda name: F.array_contains("_present", name).cast("int")
    conditions = F.transform("conditions", lambda c: F.when(c == "has_cad", "has_ihd").otherwise(c))
    drugs = lambda m: F.array_contains("medications", m).cast("int")
    lower = F.greatest(drugs("on_ace"), drugs("on_arb"), drugs("on_bb"))
    took = F.col("took_all_meds").cast("int")
    d = df.withColumn("_present", F.coalesce(present, F.array().cast("array<string>"))).withColumn("_cond", conditions)
    cols = [F.col(c) for c in df.columns if c not in ("symptoms", "conditions", "medications", "took_all_meds")]
    cols += [F.array_contains("_cond", c).cast("int").alias(c) for c in ("has_hf", "has_ihd", "has_afib")]
    cols += [drugs(m).alias(m) for m in ("on_ace", "on_arb", "on_bb", "on_loop", "on_nsaid")]
    cols += [took.alias("took_all_meds"), F.when(took.isNotNull(), ((took == 0) & (lower == 1)).cast("int")).alias("missed_antihypertensive"),
             F.col("pulse").cast("double").alias("heart_rate")]
    cols += [has(k).alias(f"sym_{k}") for k in known]
    cols += [(F.size("_present") > 0).cast("int").alias("sym_any"), F.size("_present").alias("sym_count"),
             F.greatest(*[has(k) for k in RED_FLAGS]).alias("sym_red_flag")]
    cols += [F.greatest(*[has(k) for k in members]).alias(f"sym_mech_{m}") for m, members in MECHANISMS.items()]
    cols += [F.lit(None).cast("double").alias(c) for c in ("idwg", "dryweight", "sbp_drop", "uf_total", "session_hours") if c not in df.columns]
    return d.select(*cols)


def reading_age(as_of, ts) -> Column:
    """Whole days since the reading, never negative."""
    return F.greatest(F.datediff(as_of, F.to_date(ts)), F.lit(0))


def confidence_tier(n, config: Config = Config(), age: Column | None = None) -> Column:
    cases = [(F.col(n) < config.cold_start_min, "cold_start")]
    if age is not None:
        cases.append((age > STALE_DAYS, "stale"))
    return first_of(*cases, (F.col(n) < config.steady_state, "bootstrapping"), default="steady")


def banner(emergency="is_emergency", flagged="flagged", breach="forecast_fired", fired="fired", tier="confidence_tier") -> Column:
    """Severity and title in clinical priority order."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    say = lambda severity, title: F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"))
    return first_of((yes(emergency), say("critical", "emergency on the latest reading")),
                    (yes(flagged), say("critical", "early-warning detector flagged")),
                    (yes(breach), say("watch", "breach forecast")), (yes(fired), say("watch", "rule fired on the latest reading")),
                    (F.col(tier) == "stale", say("info", "history too old for a forecast")),
                    (F.col(tier) == "cold_start", say("info", "cold start, no forecast issued")),
                    (F.col(tier) == "no_model", say("info", "rule engine only")), default=say("good", "nothing due"))


def days_after(ts, days) -> Column:
    """``ts`` moved by whole days, at least one."""
    return F.timestamp_add("DAY", F.greatest(F.floor(half_even(days, 1)), F.lit(1)).cast("int"), F.col(ts))


def chain_nodes(last: DataFrame, horizons: int, key="series_id") -> DataFrame:
    """Forecast rows per (series, node, horizon): the value moved by the node times the deviation of the band.

    Horizon h stands ``h + 1`` usual gaps (``median_gap`` days) after the last row.
    """
    sigma = F.greatest((F.col("hi80") - F.col("lo80")) / (2 * Z80), F.lit(0.0))
    nodes = F.explode(F.array(*[F.struct(F.lit(i).alias("node"), F.lit(z).alias("z"), F.lit(w).alias("weight")) for i, (z, w) in enumerate(NODES)]))
    d = last.withColumn("_s", F.coalesce(sigma, F.lit(0.0))).select("*", nodes.alias("_n")).select(
        "*", "_n.*", F.explode(F.sequence(F.lit(0), F.lit(horizons - 1))).alias("h"))
    return d.select(key, "node", "weight", "h", days_after("ts", F.col("median_gap") * (F.col("h") + 1)).cast(last.schema["ts"].dataType).alias("ts"), "median_gap",
                    (F.col("event_id") + F.col("h") + 1).alias("event_id"), (F.col("sbp_hat") + F.col("z") * F.col("_s")).alias("sbp"),
                    F.col("dbp_hat").alias("dbp"))


def chained_risk(history: DataFrame, ahead: DataFrame, config: Config, risk: Column, bound: int | None = None,
                 key="series_id") -> DataFrame:
    """Risk after each appended forecast row, integrated over the nodes, next to the risk at the point forecast.

    Each node copies the whole history: expanding and smoothed features look back to the first row. The nodes are
    literals, so the copies are made in place. A series without forecast rows yields none.
    """
    from seriesloom.operators.features import REACH, build_features
    nodes = F.array(*[F.struct(F.lit(i).alias("node"), F.lit(w).alias("weight")) for i, (_, w) in enumerate(NODES)])
    copies = history.select(key, "ts", "event_id", "sbp", "dbp", F.inline(nodes)).withColumn("h", F.lit(-1))
    marks = ahead.groupBy(key, "node", "weight").agg(F.max("ts").alias("_t"), F.max("event_id").alias("_e"), F.max("median_gap").alias("_g"))
    ahead = ahead.drop("median_gap")
    final = marks.select(key, "node", "weight", days_after("_t", F.col("_g")).cast(history.schema["ts"].dataType).alias("ts"),
                         (F.col("_e") + 1).alias("event_id"), F.lit(99).alias("h"))
    rows = copies.unionByName(ahead, allowMissingColumns=True).unionByName(final, allowMissingColumns=True)
    again = lay_out(rows, [key, "node"], ["ts", "event_id"], reach=REACH, bound=bound)
    f = build_features(again, config)
    # The row after forecast h sees it as lag 1.
    scored = f.where(F.col("h") >= 1).withColumn("risk", risk).withColumn(
        "upto_h", F.when(F.col("h") == 99, F.lit(None)).otherwise(F.col("h") - 1))
    top = ahead.agg(F.max("h").alias("_top"))
    from seriesloom.functions.lanes import attach_row
    scored = attach_row(scored, top).withColumn("upto_h", F.coalesce("upto_h", "_top"))
    return scored.groupBy(key, "upto_h").agg(F.sum(F.col("weight") * F.col("risk")).alias("risk_integrated"),
                                             F.max(F.when(F.col("node") == 0, F.col("risk"))).alias("risk_point"))
