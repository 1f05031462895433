"""Promotion gates: each is a one-row aggregate over evidence; absent evidence warns, it never passes.

Every gate looks only at its own evidence frame. A critical gate that fails blocks promotion.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.config import Config
from seriesloom.operators.rulebook import TIERS

# Gate, whether it blocks promotion.
GATES = {
    "emergency floor never personalised": True, "offset within governance caps": True,
    "detector alert rate within budget": True, "rule-engine fire rate (reported, not gated)": False,
    "personalisation preserves every emergency": True, "subgroup parity": True, "explanation is non-zero": True,
    "test rows inside the training distribution": True, "learned offset respects the emergency floor": True,
    "cold-start curve is monotone": False, "cold-start penalty bounded": False, "abstention policy is usable": False,
    "advisories are well-formed": False, "missingness degradation bounded": False,
    "symptom labels declared synthetic": False, "no symptom-derived column reaches the forecaster": False,
    "shipped forecaster is the selected forecaster": False, "shipped detector is not the rule-engine reference": False,
    "forecast pairs are physiologically coherent": False, "symptom heads have subgroup parity": False,
}


def tests(config: Config) -> dict[str, tuple[str, Column, Column, Column]]:
    """gate -> (evidence name, enough evidence, passes, observed value) as aggregates over the evidence."""
    n, c = F.count("*"), F.col
    some = n > 0
    every = lambda cond: F.count_if(~F.coalesce(cond, F.lit(False))) == 0
    return {
        "emergency floor never personalised": (
            "thresholds", some, F.max("threshold") < config.emergency_floor, F.max("threshold")),
        "offset within governance caps": (
            "thresholds", some, (F.min("offset") >= -config.cap_tighten - 1e-6) & (F.max("offset") <= config.cap_loosen + 1e-6),
            F.max(F.abs("offset"))),
        "detector alert rate within budget": (
            "detector_flags", some, F.avg(c("flagged").cast("double")) <= config.alert_budget_pct / 100 * 1.5,
            F.avg(c("flagged").cast("double"))),
        "rule-engine fire rate (reported, not gated)": (
            "alerts", some, F.lit(True), F.avg(c("fired").cast("double"))),
        "personalisation preserves every emergency": (
            "emergencies", some, F.count_if(c("in_population") & ~c("in_personal")) == 0,
            F.count_if(c("in_population") & ~c("in_personal"))),
        "subgroup parity": ("fairness", some, every(c("passes")), F.count_if(~c("passes"))),
        "explanation is non-zero": ("explanations", some, F.max(F.abs("contribution")) > 0, F.max(F.abs("contribution"))),
        "test rows inside the training distribution": (
            "abstention", some, F.avg(c("abstains").cast("double")) <= config.ood_rate_max, F.avg(c("abstains").cast("double"))),
        "learned offset respects the emergency floor": (
            "learned_thresholds", some, F.max("p") < config.emergency_floor, F.max("p")),
        "cold-start curve is monotone": (
            "cold_start", F.count("widening") >= 1, F.max("widening") <= 1.0, F.max("widening")),
        "cold-start penalty bounded": (
            "cold_penalty", some & F.max("penalty").isNotNull(), F.max("penalty") <= config.cold_penalty_max, F.max("penalty")),
        "abstention policy is usable": (
            "abstention", some, F.max("ood_cut").isNotNull() & (F.max("ood_cut") > 0), F.max("ood_cut")),
        "advisories are well-formed": (
            "advisories", some, every(c("surfaced_tier").isin(*TIERS)), F.count_if(~c("surfaced_tier").isin(*TIERS))),
        "missingness degradation bounded": (
            "missingness", n >= 2, F.max_by("mae", "drop_frac") - F.min_by("mae", "drop_frac") <= config.missing_max,
            F.max_by("mae", "drop_frac") - F.min_by("mae", "drop_frac")),
        "symptom labels declared synthetic": ("label_source", some, every(c("synthetic")), F.count_if(~c("synthetic"))),
        "no symptom-derived column reaches the forecaster": (
            "forecaster_features", some, F.count_if(c("feature").startswith("y_")) == 0, F.count_if(c("feature").startswith("y_"))),
        "shipped forecaster is the selected forecaster": (
            "shipped", some, every(c("shipped").eqNullSafe(c("selected"))), F.count_if(~c("shipped").eqNullSafe(c("selected")))),
        "shipped detector is not the rule-engine reference": (
            "detector", some, every(c("detector") != "d_fixed_threshold"), F.count_if(c("detector") == "d_fixed_threshold")),
        "forecast pairs are physiologically coherent": (
            "pairs", some, F.avg((F.size("codes") > 0).cast("double")) <= config.pair_violation_max,
            F.avg((F.size("codes") > 0).cast("double"))),
        "symptom heads have subgroup parity": ("label_fairness", some, every(c("passes")), F.count_if(~c("passes"))),
    }


def run_gates(spark: SparkSession, evidence: Mapping[str, DataFrame | None], config: Config = Config()) -> DataFrame:
    """One row per gate: status, observed value, whether it is critical.

    An evidence frame that lacks what the gate reads is a failure of the gate, not a silent pass.
    """
    out = None
    for gate, (source, enough, ok, observed) in tests(config).items():
        critical = GATES[gate]
        frame = evidence.get(source)
        if frame is None:
            one = _row(spark, gate, "WARN", critical)
        else:
            try:
                g = frame.agg(enough.alias("enough"), ok.alias("ok"), observed.cast("double").alias("observed"))
                status = (F.when(~F.coalesce("enough", F.lit(False)), "WARN").when(F.coalesce("ok", F.lit(False)), "PASS")
                          .otherwise("FAIL" if critical else "WARN"))
                one = g.select(F.lit(gate).alias("gate"), status.alias("status"), "observed", F.lit(critical).alias("critical"))
            except Exception:       # analysis errors: the evidence has the wrong shape
                one = _row(spark, gate, "FAIL" if critical else "WARN", critical)
        out = one if out is None else out.unionByName(one)
    return out


def _row(spark: SparkSession, gate: str, status: str, critical: bool) -> DataFrame:
    return spark.createDataFrame([(gate, status, None, critical)], "gate string, status string, observed double, critical boolean")


def promotable(gates: DataFrame) -> DataFrame:
    """Promotable when no critical gate failed."""
    bad = F.count_if((F.col("status") == "FAIL") & F.col("critical"))
    return gates.agg(F.count("*").alias("n_gates"), F.count_if(F.col("status") == "PASS").alias("n_pass"),
                     F.count_if(F.col("status") == "WARN").alias("n_warn"), bad.alias("n_critical_failures"),
                     (bad == 0).alias("promotable"))


def emergency_evidence(population: DataFrame, personal: DataFrame, key="series_id") -> DataFrame:
    """Emergencies of both modes side by side."""
    pick = lambda d, n: d.where("is_emergency").select(key, "step").distinct().withColumn(n, F.lit(True))
    return (pick(population, "in_population").join(pick(personal, "in_personal"), [key, "step"], "full_outer")
            .na.fill(False, ["in_population", "in_personal"]))
