"""Every check must fail on what it exists for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.config import Config
from seriesloom.functions.lanes import lay_out
from seriesloom.operators import contract as C
from seriesloom.operators import features as W
from seriesloom.operators import forecast as B
from seriesloom.operators import gates as G
from seriesloom.operators import leakage as K
from seriesloom.operators import metrics as M
from seriesloom.operators import rules as R
from seriesloom.operators import serving as V
from seriesloom.operators import stats as A
from seriesloom.operators.frames import digest, provenance
from seriesloom.operators.rulebook import RULE_TABLE, lines
from seriesloom.plans.roles import CONFIG, panel

CFG = Config()


def status(gates, name):
    return next(r.status for r in gates.collect() if r.gate == name)


def evidence(spark):
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "thresholds": mk([(1, 150.0, 10.0), (2, 130.0, -10.0)], "series_id int, threshold double, offset double"),
        "detector_flags": mk([(i < 4,) for i in range(100)], "flagged boolean"),
        "alerts": mk([(True,), (False,)], "fired boolean"),
        "emergencies": mk([(True, True), (False, True)], "in_population boolean, in_personal boolean"),
        "fairness": mk([(True,)], "passes boolean"), "explanations": mk([(0.4,)], "contribution double"),
        "abstention": mk([(i < 10, 3.0) for i in range(100)], "abstains boolean, ood_cut double"),
        "learned_thresholds": mk([(150.0,)], "p double"), "cold_start": mk([(0.5,)], "widening double"),
        "cold_penalty": mk([(2.0,)], "penalty double"), "advisories": mk([("BP_LEVEL_1_HIGH",)], "surfaced_tier string"),
        "missingness": mk([(0.0, 10.0), (0.5, 12.0)], "drop_frac double, mae double"), "label_source": mk([(True,)], "synthetic boolean"),
        "forecaster_features": mk([("sbp_lag1",)], "feature string"), "shipped": mk([("ridge", "ridge")], "shipped string, selected string"),
        "detector": mk([("d_cusum",)], "detector string"), "pairs": mk([([],)], "codes array<string>"),
        "label_fairness": mk([(True,)], "passes boolean")}


BAD = {
    "emergency floor never personalised": ("thresholds", [(1, 181.0, 41.0)], "series_id int, threshold double, offset double"),
    "offset within governance caps": ("thresholds", [(1, 160.0, 20.0)], "series_id int, threshold double, offset double"),
    "detector alert rate within budget": ("detector_flags", [(True,)], "flagged boolean"),
    "personalisation preserves every emergency": ("emergencies", [(True, False)], "in_population boolean, in_personal boolean"),
    "subgroup parity": ("fairness", [(False,)], "passes boolean"),
    "explanation is non-zero": ("explanations", [(0.0,)], "contribution double"),
    "test rows inside the training distribution": ("abstention", [(True, 3.0)], "abstains boolean, ood_cut double"),
    "learned offset respects the emergency floor": ("learned_thresholds", [(180.0,)], "p double"),
    "cold-start curve is monotone": ("cold_start", [(4.0,)], "widening double"),
    "cold-start penalty bounded": ("cold_penalty", [(9.0,)], "penalty double"),
    "advisories are well-formed": ("advisories", [("NO_SUCH_TIER",)], "surfaced_tier string"),
    "missingness degradation bounded": ("missingness", [(0.0, 10.0), (0.5, 17.0)], "drop_frac double, mae double"),
    "symptom labels declared synthetic": ("label_source", [(False,)], "synthetic boolean"),
    "no symptom-derived column reaches the forecaster": ("forecaster_features", [("y_sym",)], "feature string"),
    "shipped forecaster is the selected forecaster": ("shipped", [("ewma", "ridge")], "shipped string, selected string"),
    "shipped detector is not the rule-engine reference": ("detector", [("d_fixed_threshold",)], "detector string"),
    "forecast pairs are physiologically coherent": ("pairs", [(["inverted"],)], "codes array<string>"),
    "symptom heads have subgroup parity": ("label_fairness", [(False,)], "passes boolean"),
}


def test_good_evidence_is_promotable(spark):
    g = G.run_gates(spark, evidence(spark), CFG)
    assert {r.status for r in g.collect()} == {"PASS"}
    assert G.promotable(g).first().promotable


def test_absent_evidence_warns(spark):
    g = G.run_gates(spark, {}, CFG)
    assert {r.status for r in g.collect()} == {"WARN"} and len(G.GATES) == g.count()


def test_every_gate_bites(spark):
    good = evidence(spark)
    for gate, (source, rows, schema) in BAD.items():
        bad = G.tests(CFG)[gate]
        frame = spark.createDataFrame(rows, schema)
        assert bad[0] == source
        _, enough, ok, _ = bad
        r = frame.agg(enough.alias("e"), ok.alias("o")).first()
        assert r.e and not r.o, gate
    blocked = G.run_gates(spark, {**good, "fairness": spark.createDataFrame([(False,)], "passes boolean")}, CFG)
    assert status(blocked, "subgroup parity") == "FAIL" and not G.promotable(blocked).first().promotable


def test_contract_on_clean_and_damaged_panels(spark, sf):
    lanes = panel(spark, sf)
    rows = lanes.done(lanes.df).select("series_id", "ts", "step", "sbp", "dbp", "days_since_last_raw", "days_since_last")
    assert all(r.caught for r in C.self_test(rows, 20).collect())
    checks = {r.check: r.status for r in C.structure_checks(lanes, lanes.df, 20).collect()}
    assert checks["structure: unique (series, session)"] == "PASS"
    short = C.structure_checks(lanes, lanes.df, 10**6)
    with pytest.raises(AssertionError):
        C.enforce(short)


def test_cadence_audit_bites(spark, sf):
    lanes = panel(spark, sf)
    wrong = lanes.df.withColumn("days_since_last", F.col("days_since_last") + 1)
    got = {r.check: r.status for r in C.cadence_audit(lanes, wrong, ["days_since_last_raw"]).collect()}
    assert got["gap equals its recomputation"] == "FAIL" and got["raw gap is not a feature"] == "FAIL"


def test_schema_checks_bite(spark):
    df = spark.createDataFrame([("a", "x")], "series_id string, sbp string")
    got = {r.check: r.status for r in C.schema_checks(df, {"sbp": "number", "ts": "datetime"}, ["weight"]).collect()}
    assert got["schema: 'sbp' usable as number"] == "FAIL" and got["schema: 'ts' present"] == "FAIL"
    assert got["schema: optional columns present"] == "WARN"


def test_leakage_probes_bite(spark, sf):
    lanes = panel(spark, sf)

    def build(at, df):
        return W.with_features(at, CONFIG, df).withColumn("peek", F.lead("sbp").over(at.window))
    moved = {r.feature: r.n_moved for r in K.future_corruption(lanes, lanes.df, build, ["sbp_lag1", "sbp_z", "peek"]).collect()}
    assert moved["sbp_lag1"] == 0 and moved["sbp_z"] == 0 and moved["peek"] > 0
    f = W.build_features(lanes, CONFIG)
    bad = {r.h: r.mismatches for r in K.target_mismatches(f.withColumn("y_sbp_h1", F.col("sbp")), "sbp", (0, 1)).collect()}
    assert bad[0] == 0 and bad[1] > 0
    copy = {r.check: r.status for r in K.structural_audit(f.withColumn("twin", F.col("sbp") * 2.0), ["sbp_lag1", "twin"]).collect()}
    assert copy["no feature is a copy of the current value"] == "FAIL"
    latent = {r.check: r.status for r in K.structural_audit(f.withColumn("frailty", F.rand(1)), ["sbp_lag1", "frailty"]).collect()}
    assert latent["latent variables are not features"] == "FAIL"


def test_rules_one_by_one(spark):
    base = dict(series_id="p", step=40, sbp=120.0, dbp=80.0, n_meas=2, days_since_last=2.0)
    cases = [(dict(sbp=195.0), "RULE_ABSOLUTE_EMERGENCY"), (dict(sbp=195.0, n_meas=1), "RULE_UNCONFIRMED_EMERGENCY"),
             (dict(sbp=195.0, days_since_last=20.0), None), (dict(sbp=195.0, days_since_last=20.0, reading_age_days=0.0), "RULE_ABSOLUTE_EMERGENCY"),
             (dict(n_meas=1, sbp=150.0), None), (dict(is_pregnant=1, sbp=162.0), "RULE_PREGNANCY_L2"),
             (dict(face_swelling=1, on_ace=1), "RULE_ACE_ANGIOEDEMA"), (dict(hf_type="HFREF", sbp=95.0), "RULE_HFREF_LOW"),
             (dict(pulse=45.0, dizziness=1), "RULE_BRADY_HR_SYMPTOMATIC"), (dict(brady_run_len=3), "RULE_BRADY_SURVEILLANCE"),
             (dict(brady_run_len=2), "RULE_BRADY_SURVEILLANCE"), (dict(ml_threshold=118.0), "RULE_PERSONALIZED_HIGH"),
             (dict(provider_target=141.0), "RULE_PERSONALIZED_LOW"), (dict(sbp=139.0, dbp=60.0), "RULE_PULSE_PRESSURE_WIDE"),
             (dict(step=5, adherence_7d=0.5), "RULE_FIRST_MONTH_ADHERENCE_NUDGE"), (dict(), None)]
    cols = sorted({k for c, _ in cases for k in c} | set(base))
    kinds = {"series_id": "string", "hf_type": "string", "step": "int", "n_meas": "int", "is_pregnant": "int", "face_swelling": "int",
             "on_ace": "int", "dizziness": "int", "brady_run_len": "int"}
    data = [(i, *[{**base, **c}.get(k) for k in cols]) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(data, "case int, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in cols))
    got = {r.case: r for r in R.evaluate_extended(df).collect()}
    for i, (change, want) in enumerate(cases):
        assert got[i].rule_id == want, (change, got[i])
    assert got[10].tier == "TIER_3_INFO" and got[9].tier == "TIER_2_DISCREPANCY" and got[11]["mode"] == "PERSONALIZED"
    assert got[1].gate_reason == "UNCONFIRMED_TERMINAL" and got[0].is_emergency and not got[2].fired


def test_registry_counts(spark):
    reg = R.registry(spark).collect()
    assert len(reg) == 57 and len({r.rule_id for r in reg}) == 56
    assert len(lines(RULE_TABLE)) == 57
    assert next(r for r in reg if r.rule_id == "RULE_TACHY_HR").status == "BLOCKED_ON_INPUTS"
    assert next(r for r in R.registry(spark, ("pulse",)).collect() if r.rule_id == "RULE_TACHY_HR").status == "EVALUABLE"


def test_pair_coherence(spark):
    df = spark.createDataFrame([(142.0, 149.0, 60.0), (142.0, 88.0, 60.0), (130.0, 130.0, 60.0), (400.0, 90.0, 60.0), (50.0, 20.0, 60.0),
                                (150.0, 70.0, 45.0), (None, 80.0, 60.0), (142.0, 88.0, None)], "s double, d double, pp_ref double")
    got = [r.c for r in df.withColumn("pp_abs_dev_p99", F.lit(30.0)).select(B.pair_codes("s", "d").alias("c")).collect()]
    assert got[0][0] == "inverted" and got[1] == [] and got[2][0] == "inverted" and "sbp_out_of_range" in got[3]
    assert {"sbp_out_of_range", "dbp_out_of_range"} <= set(got[4]) and got[5] == ["pp_far_from_baseline"]
    assert got[6] == ["leg_missing"] and got[7] == []


def test_slice_gate_separates_difficulty_from_unfairness(spark):
    rows = [("hard" if i % 3 == 0 else "easy", 2.0 if i % 3 == 0 else 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "grp string, noise double").withColumn("base", F.col("noise") * 10).withColumn("err", F.col("noise") * 10 - 2)
    raw = M.slice_gate(df, ["grp"], F.avg("err"), 1.5, "MAE").collect()
    fair = M.slice_gate(df, ["grp"], F.avg("err"), 1.5, "MAE", reference=F.avg("base")).collect()
    assert not all(r.passes for r in raw) and all(r.passes for r in fair)
    unfair = df.withColumn("err", F.when(F.col("grp") == "hard", F.col("base") + 3).otherwise(F.col("err")))
    assert not all(r.passes for r in M.slice_gate(unfair, ["grp"], F.avg("err"), 1.5, "MAE", reference=F.avg("base")).collect())


def test_requests(spark):
    day = dt.date(2026, 1, 1)
    ok = ("a", day, 120, 80, ["dizziness"], ["has_cad"], ["on_ace"], 0, 0, "HFREF")
    rows = [ok, ("b", day, 120, 115, [], [], [], 0, 0, "NONE"), ("c", day, 120, 80, [], [], [], 0, 0, "NONE"),
            ("c", day, 121, 80, [], [], [], 0, 0, "NONE"), ("d", day, 120, 80, [], ["has_wings"], [], 0, 0, "NONE"),
            ("e", day, 120, 80, [], [], ["on_magic"], 0, 0, "NONE"), ("f", day, 120, 80, [], [], [], 1, 1, "NONE")]
    df = spark.createDataFrame(rows, "patient_id string, date date, sbp int, dbp int, symptoms array<string>, conditions array<string>, "
                               "medications array<string>, is_male int, is_pregnant int, hf_type string")
    got = V.reading_errors(df)
    errors = {(r.patient_id, r.sbp): r.errors for r in got.collect()}
    assert errors[("a", 120)] == [] and errors[("b", 120)] == ["pulse_pressure"] and errors[("c", 121)] == ["duplicate_date"]
    assert errors[("d", 120)] == ["unknown_conditions"] and errors[("e", 120)] == ["unknown_medications"]
    assert errors[("f", 120)] == ["pregnant_and_male"]
    assert "has_hf" in V.valid(got).first().conditions


def test_digest_and_provenance(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 1.5)
    a, b = digest(df).first(), digest(df.select("v", "id").orderBy(F.col("id").desc())).first()
    assert a == b and digest(df.withColumn("v", F.col("v") + F.when(F.col("id") == 3, 1).otherwise(0))).first() != a
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    good = provenance({"real": ids("a", "b"), "other": ids("s"), "real_alerts": ids("a"), "other_alerts": ids("s")})
    assert all(r.holds for r in good.collect())
    bad = {r.check: r.holds for r in provenance({"real": ids("a"), "other": ids("a"), "real_alerts": ids("a", "z"), "other_alerts": ids("q")}).collect()}
    assert not any(bad.values())


def test_drift_bites(spark):
    base = spark.range(500).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    moved = spark.range(500).select((F.rand(3) + 0.5).alias("x"), F.rand(4).alias("y"))
    ks = {r.feature: r for r in A.ks_two_sample(base, moved, ["x", "y"]).collect()}
    assert ks["x"].drift and not ks["y"].drift
    psi = {r.feature: r.psi for r in A.psi(base, moved, ["x", "y"]).collect()}
    assert psi["x"] > 0.2 > psi["y"]


def test_long_histories_are_valid(spark):
    rows = spark.range(401).select(
        F.lit(1).alias("patient_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        *[F.lit(v).alias(c) for c, v in (("sbp", 130), ("dbp", 80), ("pulse", 70))])
    assert V.valid(V.reading_errors(rows)).count() == 401


def test_chained_risk_reads_the_whole_history(spark):
    n = 80
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    history = spark.createDataFrame([(1, day(i), i, 100.0 + i, 70.0) for i in range(n)], "series_id int, ts timestamp, event_id long, sbp double, dbp double")
    last = spark.createDataFrame([(1, day(n - 1), n - 1, 500.0, 70.0, 500.0, 500.0, 2.0)],
                                 "series_id int, ts timestamp, event_id long, sbp_hat double, dbp_hat double, lo80 double, hi80 double, median_gap double")
    ahead = V.chain_nodes(last, 3)
    assert {r.ts for r in ahead.collect()} == {day(n - 1 + k) for k in (2, 4, 6)}
    got = {r.upto_h: r.risk_integrated for r in V.chained_risk(history, ahead, CFG, F.col("sbp_base_mean")).collect()}
    for h in range(3):
        before = [100.0 + i for i in range(n)] + [500.0] * (h + 1)
        assert got[h] == pytest.approx(sum(before) / len(before))


def test_drift_report_keeps_every_column(spark):
    scores = spark.range(25).select(F.concat(F.lit("c"), F.col("id")).alias("feature"), F.lit(0.3).alias("psi"))
    got = A.drift_report(scores).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 26)) and {r.status for r in got} == {"ALARM"}
