"""Rule evaluation over whole panels: ordered cascades compiled to CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.config import STALE_DAYS
from seriesloom.functions.expr import any_of, clip, finite, first_of, half_even
from seriesloom.functions.lanes import Lanes, attach_row
from seriesloom.functions.skew import attach
from seriesloom.operators.rulebook import (BASE_INPUTS, CASCADE, CONDITIONS, DISPOSITIONS, DISPOSITION_TIERS,
                                           EMERGENCY_TIERS, MECHANISMS, MEDICATIONS, NUMBERS, OTHER_FLAGS, RED_FLAGS,
                                           RULE_TABLE, SYMPTOMS, TEXTS, TIER_TABLE, TIERS, lines)


def registry(spark: SparkSession, available: Sequence[str] = BASE_INPUTS) -> DataFrame:
    """Every (rule, tier) slot with the inputs that block it."""
    rows = [(r, t, n.split()) for r, t, n in lines(RULE_TABLE)]
    df = spark.createDataFrame(rows, "rule_id string, tier string, needs array<string>")
    blocked = F.array_sort(F.array_except("needs", F.array(*[F.lit(a) for a in available])))
    return (df.withColumn("blocked_by", blocked)
            .withColumn("status", F.when(F.size("blocked_by") == 0, "EVALUABLE").otherwise("BLOCKED_ON_INPUTS"))
            .withColumn("is_emergency", F.col("tier").isin(*EMERGENCY_TIERS)))


def tier_policy(spark: SparkSession) -> DataFrame:
    """Tiers by rank, and whether a personal threshold may move them."""
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(TIER_TABLE)], "tier_rank int, tier string, personalisable boolean")


def gate(df: DataFrame) -> Column:
    """Old readings and lone readings are gated; a known reading age wins over the gap."""
    have = set(df.columns)
    gap = F.col("days_since_last") if "days_since_last" in have else F.lit(None).cast("double")
    age = finite("reading_age_days") if "reading_age_days" in have else F.lit(None).cast("double")
    n = F.coalesce(F.col("n_meas"), F.lit(99)) if "n_meas" in have else F.lit(99)
    return first_of((F.coalesce(age, gap) > STALE_DAYS, "HISTORICAL_ENTRY"),
                    (n < 2, "SINGLE_READING_NON_EMERGENCY"), default="NONE")


def decide(df: DataFrame, keep: Sequence[str], cases: Sequence[tuple[Column, dict | None]]) -> DataFrame:
    """Evaluate an ordered cascade: one CASE yields the number of the first match, literals yield the rest.

    A case without outcome ends the cascade silently. ``_gate`` is the gate of the row.
    """
    outcomes = [None] + [o for _, o in cases]         # entry 1 of each list: no case matched
    hit = F.coalesce(first_of(*[(c, i + 2) for i, (c, _) in enumerate(cases)]), F.lit(1))
    # Looked up in lists rather than compared: a filter on these columns then stays one small expression.
    look = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_hit"))
    text = lambda field: look([(o or {}).get(field) for o in outcomes], "string")
    mark = lambda test: look([bool(o and test(o)) for o in outcomes], "boolean")
    gates = [("UNCONFIRMED_TERMINAL" if o and o.get("terminal") else None) for o in outcomes]
    # One-element explode: filters on the verdict stay above it, so the optimizer never copies the long CASE
    # into predicates and the constraints it infers from them.
    return df.withColumn("_hit", F.explode(F.array(hit))).select(
        *keep, text("tier").alias("tier"), text("rule").alias("rule_id"),
        look(["PERSONALIZED" if o and o["rule"].startswith("RULE_PERSONALIZED") else "STANDARD" for o in outcomes],
             "string").alias("mode"),
        F.coalesce(look(gates, "string"), F.col("_gate")).alias("gate_reason"),
        mark(lambda o: o.get("short")).alias("short_circuited"), mark(lambda o: True).alias("fired"),
        mark(lambda o: o["tier"] in EMERGENCY_TIERS).alias("is_emergency"))


def evaluate_base(lanes: Lanes, df: DataFrame, threshold: str | None = None) -> DataFrame:
    """The base cascade in population mode, or personalised by a per-row threshold column.

    The previous row's verdict matters only through its own emergency test, so the cascade needs no
    recursion: one lag is enough.
    """
    keep = df.columns
    g = F.col("_gate")
    emergency = (F.col("sbp") >= 180) | (F.col("dbp") >= 120)
    fires = F.coalesce(emergency, F.lit(False)) & (g != "HISTORICAL_ENTRY")
    df = df.withColumn("_gate", gate(df)).withColumn("_emergency", fires)
    previous = F.coalesce(F.lag("_emergency").over(lanes.window), F.lit(False))
    df = df.withColumn("_previous", previous)
    cases = base_cases(F.col("_emergency"), F.col("_previous"), threshold, "age" in keep, "idwg" in keep)
    return decide(df, keep, cases)


def base_cases(emergency: Column, previous: Column, threshold: str | None = None, age: bool = True,
               idwg: bool = False) -> list[tuple[Column, dict | None]]:
    """The base cascade in order; ``emergency`` already respects the gate in ``_gate``."""
    hit = lambda rule, tier, **more: dict(rule=rule, tier=tier, **more)
    sbp, dbp = F.col("sbp"), F.col("dbp")
    cases = [(emergency, hit("RULE_ABSOLUTE_EMERGENCY", "BP_LEVEL_2", short=True)), (F.col("_gate") != "NONE", None)]
    if threshold:
        cases.append((sbp >= F.col(threshold), hit("RULE_PERSONALIZED_HIGH", "BP_LEVEL_1_HIGH")))
    cases.append(((sbp >= 140) | (dbp >= 90), hit("RULE_STANDARD_L1_HIGH", "BP_LEVEL_1_HIGH")))
    if age:
        cases.append(((F.col("age") >= 65) & (sbp < 100), hit("RULE_AGE_65_LOW", "BP_LEVEL_1_LOW")))
    cases.append(((sbp < 90) | (dbp < 60), hit("RULE_STANDARD_L1_LOW", "BP_LEVEL_1_LOW")))
    if idwg:
        cases.append((finite("idwg") >= 4.0, hit("RULE_HF_DECOMPENSATION", "BP_LEVEL_1_LOW")))
    return cases + [(previous & (sbp < 140), hit("RULE_EMERGENCY_RANGE_CONFIRMED_NORMAL", "TIER_3_INFO")),
                    (sbp - dbp >= 60, hit("RULE_PULSE_PRESSURE_WIDE", "TIER_3_INFO")),
                    (sbp - dbp <= 25, hit("RULE_PULSE_PRESSURE_NARROW", "TIER_3_INFO")),
                    (F.col("step") < 12, hit("RULE_FIRST_MONTH_ADHERENCE_NUDGE", "TIER_3_INFO"))]


def _inputs(df: DataFrame) -> list[Column]:
    """Everything the extended rules read, under its plain name, with defaults for what is missing."""
    have = set(df.columns)
    out = []
    for f in [*CONDITIONS, *MEDICATIONS, *SYMPTOMS, *OTHER_FLAGS]:
        flag = F.coalesce(F.col(f).cast("int") != 0, F.lit(False)) if f in have else F.lit(False)
        out.append(flag.alias(f))
    for n in NUMBERS:
        value = finite(n) if n in have else F.lit(None).cast("double")
        out.append((F.coalesce(value, F.lit(99.0)) if n == "n_meas" else value).alias(n))
    for t, default in TEXTS.items():
        out.append((F.coalesce(F.col(t), F.lit(default)) if t in have else F.lit(default)).alias(t))
    return out


def evaluate_extended(df: DataFrame) -> DataFrame:
    """Five ordered axes over vitals, pulse, symptoms, conditions, drugs, adherence and posture.

    ``prev_emergency``, ``hr_high_recent`` and ``brady_run_len`` are columns prepared beforehand.
    """
    keep = df.columns
    ready = df.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), gate(df).alias("_gate"), *_inputs(df))
    g = F.col("_gate")
    axes: dict[str, list] = {}
    for axis, rule, tier, condition in lines(CASCADE):
        axes.setdefault(axis, []).append((rule, tier, F.expr(condition)))
    lone = next(c for r, _, c in axes["CONTRAINDICATION"] if r == "RULE_UNCONFIRMED_EMERGENCY")
    urgent = any_of([F.coalesce(c, F.lit(False)) for _, _, c in axes["EMERGENCY"]])
    cases = [(urgent & (g == "HISTORICAL_ENTRY"), None)]
    cases += [(c, dict(rule=r, tier=t, short=True)) for r, t, c in axes["EMERGENCY"]]
    cases += [((g == "SINGLE_READING_NON_EMERGENCY") & lone,
               dict(rule="RULE_UNCONFIRMED_EMERGENCY", tier="TIER_1_CONTRAINDICATION", terminal=True)),
              (g != "NONE", None)]
    for axis in ("CONTRAINDICATION", "TIER_2", "L1", "TIER_3"):
        cases += [(c, dict(rule=r, tier=t)) for r, t, c in axes[axis]]
    return decide(ready, [f"_row.{c}" for c in keep], cases)


def with_threshold(df: DataFrame, thresholds: DataFrame, key="series_id", name="ml_threshold", bound: int | None = None) -> DataFrame:
    """One personal threshold per series on every row."""
    return attach(df, thresholds.select(key, F.col("threshold").alias(name)), key, bound=bound)


def coverage(reg: DataFrame, alerts_a: DataFrame, alerts_b: DataFrame) -> DataFrame:
    """Which rules fired on each population, and what that is evidence of."""
    fired = lambda d, n: (d.where("fired").select("rule_id").distinct().withColumn(n, F.lit(True)))
    one = reg.groupBy("rule_id").agg(F.min("status").alias("status"))
    out = (one.join(fired(alerts_a, "fired_on_a"), "rule_id", "left").join(fired(alerts_b, "fired_on_b"), "rule_id", "left")
           .na.fill(False, ["fired_on_a", "fired_on_b"]))
    return out.select("*", (F.col("fired_on_a") | F.col("fired_on_b")).alias("covered"),
                      first_of((F.col("fired_on_a"), "observed"), (F.col("fired_on_b"), "reachable only"),
                               default="never fired").alias("evidence"))


def summary(alerts: DataFrame, key="series_id") -> DataFrame:
    """Per series: how often rules fired, and the verdict on the newest row."""
    last = F.max_by(F.struct("fired", "is_emergency", "tier", "rule_id", "mode", "gate_reason"), F.col("step"))
    out = alerts.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if("fired").alias("fired_count"),
                                  F.count_if("is_emergency").alias("emergency_count"), last.alias("_last"))
    return out.select(key, "n_rows", "fired_count", "emergency_count", "_last.*")


def tier_counts(alerts: DataFrame) -> DataFrame:
    return alerts.where("fired").groupBy("tier", "rule_id").agg(F.count("*").alias("n"))


def predicted_alerts(last_rows: DataFrame, forecast: DataFrame, key="series_id") -> DataFrame:
    """Every forecast row judged as a confirmed two-reading session, in horizon order.

    ``last_rows`` holds the newest prepared panel row per series, ``forecast`` one row per (series, h)
    with ``sbp_hat``, ``dbp_hat`` and ``target_ts``. Whether the row before was an emergency follows from
    that row's own vitals, so one pass with a lag over at most a few horizons is enough.
    """
    from pyspark.sql import Window
    carried = last_rows.drop("n_meas", "reading_age_days", "prev_emergency")
    rows = (forecast.join(carried.withColumnsRenamed({"sbp": "_sbp0", "dbp": "_dbp0", "step": "_step0"}), key)
            .withColumn("sbp", F.col("sbp_hat")).withColumn("dbp", F.coalesce("dbp_hat", "_dbp0"))
            .withColumn("step", F.col("_step0") + F.col("h") + 1)
            .withColumn("reading_age_days", F.lit(0.0)).withColumn("n_meas", F.lit(2))
            .withColumn("prev_emergency", F.lit(False)))
    own = evaluate_extended(rows)
    level2 = F.col("tier") == "BP_LEVEL_2"
    before = F.lag(F.coalesce(level2, F.lit(False))).over(Window.partitionBy(key).orderBy("h"))
    out = own.withColumn("_prev", F.coalesce(before, F.col("_sbp0") >= 180, F.lit(False)))
    # Only the confirmed-normal rule reads the flag; it leads its axis and applies where no other axis fired.
    normal = (F.col("_prev") & (F.col("sbp") < 140) & (F.col("gate_reason") == "NONE")
              & (F.col("tier").isNull() | (F.col("tier") == "TIER_3_INFO")))
    return (out.withColumn("tier", F.when(normal, "TIER_3_INFO").otherwise(F.col("tier")))
            .withColumn("rule_id", F.when(normal, "RULE_EMERGENCY_RANGE_CONFIRMED_NORMAL").otherwise(F.col("rule_id")))
            .withColumn("fired", F.col("tier").isNotNull()))


def drift_advisories(forecast: DataFrame, thresholds: DataFrame, key="series_id", bound: int | None = None) -> DataFrame:
    """The earliest horizon whose forecast reaches the personal threshold."""
    hit = attach(forecast, thresholds.select(key, "threshold"), key, "inner", bound).where(F.col("sbp_hat") >= F.col("threshold"))
    first = hit.groupBy(key).agg(F.min_by(F.struct("h", "days_ahead", "sbp_hat", "threshold"), "h").alias("a")).select(key, "a.*")
    margin = F.col("sbp_hat") - F.col("threshold")
    return first.select(key, F.lit("PREDICT_BP_DRIFT_TOWARD_L1").alias("advisory"),
                        F.col("days_ahead").alias("horizon_days"),
                        half_even(clip(F.lit(0.5) + margin / 40.0, 0.0, 0.99), 3).alias("confidence"),
                        F.lit("BP_LEVEL_1_HIGH").alias("surfaced_tier"), F.lit("FULL").alias("data_quality"))


def fluid_advisories(lanes: Lanes, df: DataFrame, value="idwg", gap="days_since_last_raw") -> DataFrame:
    """Rising fluid: slope of the last eight known values above 0.05 and mean of the last three at least 3."""
    key = lanes.key[0]
    counted = lanes.whole(lanes.running(df, _c=("count", F.col(value))), _n=F.count(value))
    usual = F.coalesce(F.nullif(F.percentile(gap, F.lit(0.5)), F.lit(0.0)), F.lit(2.0))
    gaps = lanes.done(df).groupBy(key).agg(usual.alias("_gap"))
    last = lanes.done(counted).where(F.col(value).isNotNull() & (F.col("_c") > F.col("_n") - 8))
    g = last.groupBy(key).agg(
        F.count("*").alias("_k"), F.regr_slope(F.col(value), F.col("_c").cast("double")).alias("slope"),
        F.avg(F.when(F.col("_c") > F.col("_n") - 3, F.col(value))).alias("recent"))
    hit = g.where((F.col("_k") >= 8) & (F.col("slope") > 0.05) & (F.col("recent") >= 3.0)).join(gaps, key)
    return hit.select(key, F.lit("PREDICT_HF_DECOMP_IMMINENT").alias("advisory"),
                      (F.col("_gap") * 3).alias("horizon_days"),
                      half_even(clip(F.lit(0.4) + F.col("slope"), 0.0, 0.95), 3).alias("confidence"),
                      F.lit("BP_LEVEL_1_LOW").alias("surfaced_tier"), F.lit("PROXY").alias("data_quality"))


def trend_advisories(flagged: DataFrame, key="series_id", tier="BP_LEVEL_1_HIGH", confidence=0.5) -> DataFrame:
    """Series whose newest row the detector flags; ``tier`` and ``confidence`` may be columns of a tier head."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return flagged.select(key, F.lit("PREDICT_ANOMALY_TREND").alias("advisory"),
                          F.col("est_lead_days").cast("double").alias("horizon_days"),
                          as_column(confidence).alias("confidence"), as_column(tier).alias("surfaced_tier"),
                          F.lit("FULL").alias("data_quality"))


def arbitrate(advisories: DataFrame, fired_today: DataFrame, tau: float = 0.55, key="series_id") -> DataFrame:
    """Suppress weak advisories and tiers that already fired; rank the rest by tier, then horizon."""
    from pyspark.sql import Window
    done = fired_today.select(key, F.col("tier").alias("surfaced_tier")).distinct().withColumn("_fired", F.lit(True))
    rank = F.coalesce(F.element_at(F.create_map(*[x for i, t in enumerate(TIERS) for x in (F.lit(t), F.lit(i))]),
                                   F.col("surfaced_tier")), F.lit(99))
    judged = advisories.join(done, [key, "surfaced_tier"], "left").withColumn(
        "status", first_of((F.col("confidence") < tau, "SUPPRESSED_LOW_CONFIDENCE"),
                           (F.col("_fired").isNotNull(), "SUPPRESSED_ALREADY_FIRED"), default="SHOWN")).drop("_fired")
    order = Window.partitionBy(key, "status").orderBy(rank, "horizon_days", "advisory")
    return judged.withColumn("position", F.when(F.col("status") == "SHOWN", F.row_number().over(order)))


def arbitration_log(judged: DataFrame, key="series_id") -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    shown = n("SHOWN")
    return judged.groupBy(key).agg(
        F.count("*").alias("received"), n("SUPPRESSED_LOW_CONFIDENCE").alias("suppressed_low_confidence"),
        n("SUPPRESSED_ALREADY_FIRED").alias("suppressed_engine_already_fired"), shown.alias("shown"),
        F.greatest(shown - 1, F.lit(0)).alias("bundled"))


def symptom_rollups(df: DataFrame, symptoms: Sequence[str], prefix="sym_", drop="sbp_drop") -> DataFrame:
    """Any, count, red flag, four mechanisms, and a fall of 20 with any symptom."""
    have = [s for s in symptoms if f"{prefix}{s}" in df.columns]
    flag = lambda names: F.greatest(F.lit(0), F.lit(0), *[F.col(f"{prefix}{s}") for s in names if s in have])
    out = [flag(have).alias("sym_any"),
           sum((F.col(f"{prefix}{s}") for s in have), F.lit(0)).alias("sym_count"),
           flag(RED_FLAGS).alias("sym_red_flag")]
    out += [flag(members).alias(f"sym_mech_{m}") for m, members in MECHANISMS.items()]
    kdoqi = ((F.coalesce(F.col(drop), F.lit(0)) >= 20) & (flag(have) == 1)).cast("int")
    return df.select("*", *out, kdoqi.alias("idh_kdoqi"))


def disposition_class(action) -> Column:
    c = F.col(action) if isinstance(action, str) else action
    return first_of(*[(c.isin(*actions), cls) for cls, actions in DISPOSITIONS.items()])


def label_dispositions(alerts: DataFrame, action="disposition", lag="disposition_lag_days", ts="ts") -> DataFrame:
    """Class, loss weight, binary label and the day the label became known."""
    cls = F.col("disposition_class")
    return (alerts.withColumn("disposition_class", disposition_class(action))
            .withColumn("loss_weight", first_of((cls == "deferred", 0.4), (cls == "unreachable", 0.0), default=1.0))
            .withColumn("binary_label", first_of((cls.isin("positive", "deferred"), 1), (cls == "negative", 0)))
            .withColumn("label_available_at", F.date_add(F.to_date(ts), F.col(lag))))


def label_quality(labelled: DataFrame, latency_days: int = 14, ts="ts", second="second_label") -> DataFrame:
    """Training terminus, labels not yet landed, agreement and kappa of double-reviewed rows."""
    end = labelled.agg(F.date_sub(F.to_date(F.max(ts)), latency_days).alias("training_terminus"))
    both = F.col(second).isNotNull() & F.col("binary_label").isNotNull()
    same = F.avg(F.when(both, (F.col(second) == F.col("binary_label")).cast("double")))
    out = attach_row(labelled, end).groupBy("training_terminus").agg(
        F.count("*").alias("alerts_fired"), F.count("disposition_class").alias("with_disposition_path"),
        F.count_if(F.to_date(ts) > F.col("training_terminus")).alias("labels_not_yet_landed"),
        F.count_if(both).alias("double_reviewed"), same.alias("_agree"))
    enough = F.col("double_reviewed") > 10
    return out.select("training_terminus", "alerts_fired", "with_disposition_path", "labels_not_yet_landed",
                      "double_reviewed", F.when(enough, half_even("_agree", 4)).alias("raw_agreement"),
                      F.when(enough, half_even((F.col("_agree") - 0.5) / 0.5, 3)).alias("kappa"))


def disposition_coverage(reg: DataFrame) -> DataFrame:
    """Rules with and without a resolution path, one row per tier in severity order."""
    spark = reg.sparkSession
    tiers = spark.createDataFrame(list(enumerate(TIERS)), "tier_rank int, tier string")
    has = F.col("tier").isin(*DISPOSITION_TIERS)
    n = reg.groupBy("tier").agg(F.count_if(has).alias("with_disposition"), F.count_if(~has).alias("without_disposition"))
    return tiers.join(n, "tier", "left").na.fill(0, ["with_disposition", "without_disposition"])


def classifier_frame(features: DataFrame, alerts: DataFrame, h: int, key="series_id") -> DataFrame:
    """Features at step t with the alert at step t + h as label."""
    shifted = alerts.select(key, (F.col("step") - h).alias("step"), F.col("tier").alias("tier_next"),
                            F.col("rule_id").alias("rule_next"), F.col("gate_reason").alias("gate_next"))
    out = features.join(shifted, [key, "step"], "left")
    clean = F.col("tier_next").isNull() & (F.coalesce("gate_next", F.lit("NONE")) == "NONE")
    return (out.withColumn("clean_negative", clean)
            .withColumn("tier_label", F.coalesce("tier_next", F.lit("NO_ALERT")))
            .withColumn("trainable", F.col("tier_next").isNotNull() | F.col("clean_negative")))
