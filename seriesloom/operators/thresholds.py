"""Personal thresholds: cohort priors, shrinkage, grid search, multi-cut frame, learned candidates, boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.config import Config
from seriesloom.functions.expr import bucket, clip, cohort_key, half_even
from seriesloom.functions.lanes import attach_row
from seriesloom.functions.quantile import quantiles

KEY = "series_id"


def q_name(q: float) -> str:
    return f"q{int(round(q * 1000))}"


def cap(threshold, config: Config = Config()) -> Column:
    """Clamp into the governance band around the population threshold."""
    base = F.lit(config.population_threshold)
    return base + clip((F.col(threshold) if isinstance(threshold, str) else threshold) - base,
                       -config.cap_tighten, config.cap_loosen)


def warm_rows(panel: DataFrame, warms: Sequence[int], value="sbp") -> DataFrame:
    """Known values of the first ``warm`` steps, one copy per warm-up length."""
    copies = F.explode(F.filter(F.array(*[F.lit(w) for w in warms]), lambda w: w > F.col("step")))
    return (panel.where(F.col(value).isNotNull() & (F.col("step") < max(warms)))
            .select(KEY, "step", F.col(value).cast("double").alias("v"), "patient_split",
                    F.coalesce(F.col("age"), F.lit(65.0)).alias("age"), "is_male", "is_dm",
                    cohort_key("age", "is_male").alias("cohort_key"), copies.alias("warm")))


def priors(warm: DataFrame, qs: Sequence[float], bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Quantiles of the warm-up values of fit series, per (warm, cohort) and per warm."""
    pool = warm.where(F.col("patient_split") == "fit")
    names = {f"cohort_{q_name(q)}": q for q in qs}
    every = {f"global_{q_name(q)}": q for q in qs}
    return (quantiles(pool, ["warm", "cohort_key"], "v", names, bound),
            quantiles(pool, ["warm"], "v", every, bound))


def bands(warm: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Per (series, warm): how many values, and the personal quantiles. Groups hold at most ``warm`` rows."""
    first = F.min_by(F.struct("patient_split", "age", "is_male", "is_dm", "cohort_key"), F.col("step")).alias("_s")
    own = F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("_q")
    return warm.groupBy(KEY, "warm").agg(F.count("*").alias("n"), first, own).select(
        KEY, "warm", "n", "_s.*", *[F.col("_q")[i].alias(f"personal_{q_name(q)}") for i, q in enumerate(qs)])


def blend(n, personal, cohort, k) -> Column:
    """Shrink the personal quantile toward the cohort prior by n / (n + k); below five values only the prior."""
    w = F.when(F.col(n) >= 5, F.col(n) / (F.col(n) + F.lit(1.0) * k)).otherwise(F.lit(0.0))
    return w * F.when(F.col(n) >= 5, F.col(personal)).otherwise(F.col(cohort)) + (1 - w) * F.col(cohort)


def with_priors(rows: DataFrame, cohort: DataFrame, every: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Cohort priors, the global one where a cohort has none. One row per (warm, cohort): a few dozen."""
    out = rows.join(F.broadcast(cohort), ["warm", "cohort_key"], "left").join(F.broadcast(every), "warm", "left")
    return out.select(*rows.columns, *[F.coalesce(f"cohort_{q_name(q)}", f"global_{q_name(q)}")
                                       .alias(f"cohort_{q_name(q)}") for q in qs])


def thresholds(panel: DataFrame, config: Config = Config(), value="sbp", bound: int | None = None) -> DataFrame:
    """One capped threshold per series with at least five warm-up values."""
    q = config.quantile
    warm = warm_rows(panel, [config.warm], value)
    c, g = priors(warm, [q], bound)
    rows = with_priors(bands(warm, [q]), c, g, [q]).where(F.col("n") >= 5)
    p, co = f"personal_{q_name(q)}", f"cohort_{q_name(q)}"
    rows = rows.withColumn("_blend", blend("n", p, co, config.shrink_k)).withColumn("_cap", cap("_blend", config))
    return rows.select(
        KEY, "patient_split", "is_male", "is_dm", "age", "cohort_key",
        half_even("_cap", 1).alias("threshold"),
        half_even(F.col("_cap") - config.population_threshold, 1).alias("offset"),
        half_even(co, 1).alias("cohort"), half_even(p, 1).alias("personal"), F.col("n").alias("n_warm"),
        half_even(F.col("n") / (F.col("n") + config.shrink_k), 3).alias("shrinkage_w"),
        (F.abs(F.col("_blend") - F.col("_cap")) > 1e-6).alias("capped"))


def observed_band(panel: DataFrame, warm: int, q: float = 0.90, value="sbp", bound: int | None = None) -> DataFrame:
    """The band each series occupies after warm-up."""
    return quantiles(panel.where(F.col("step") >= warm), [KEY], value, {"actual": q}, bound)


def search(panel: DataFrame, config: Config = Config(), value="sbp", bound: int | None = None,
           cohort_bound: int | None = None, least: int = 20) -> DataFrame:
    """MAE against the later q0.90 of fit series for every (warm, k, q); the caps are never searched."""
    qs, warms = list(config.search_q), list(config.search_warm)
    warm = warm_rows(panel, warms, value)
    c, g = priors(warm, qs, cohort_bound)
    rows = with_priors(bands(warm, qs).where((F.col("n") >= 5) & (F.col("patient_split") == "fit")), c, g, qs)
    after = panel.where(F.col(value).isNotNull()).select(
        KEY, F.col(value).alias("v"),
        F.explode(F.filter(F.array(*[F.lit(w) for w in warms]), lambda w: w <= F.col("step"))).alias("warm"))
    actual = quantiles(after, [KEY, "warm"], "v", {"actual": 0.90}, bound)
    configs = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(q).alias("q"),
                                 F.col(f"personal_{q_name(q)}").alias("personal"),
                                 F.col(f"cohort_{q_name(q)}").alias("cohort"))
                        for k in config.search_k for q in qs])
    each = rows.join(actual, [KEY, "warm"]).select("warm", "n", "actual", F.inline(configs))
    thr = half_even(cap(blend("n", "personal", "cohort", F.col("k")), config), 1)
    return (each.withColumn("threshold", thr).groupBy("warm", "k", "q")
            .agg(F.count("*").alias("n"), F.avg(F.abs(F.col("actual") - F.col("threshold"))).alias("mae_fit"))
            .where(F.col("n") >= least))


def best_config(scores: DataFrame) -> DataFrame:
    return scores.orderBy("mae_fit", "warm", "k", "q").limit(1)


def scorecard(band: DataFrame, config: Config = Config()) -> DataFrame:
    """Blend, personal, cohort and constant, all capped: error, fit and whether the raw value was legal.

    ``band`` has threshold, personal, cohort and actual, one row per series.
    """
    base = F.lit(config.population_threshold)
    forms = {"learned (capped blend)": F.col("threshold"), "personal only": F.col("personal"),
             "cohort only": F.col("cohort"), "population constant": base}
    long = band.select("actual", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), c.cast("double").alias("raw")) for n, c in forms.items()])))
    p = cap("raw", config)
    err = F.col("actual") - p
    mean = F.avg("actual")
    scored = long.groupBy("model").agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"),
        (1 - F.sum(err * err) / F.nullif(F.sum(F.col("actual") * F.col("actual")) - F.count("*") * mean * mean,
                                         F.lit(0.0))).alias("r2"),
        F.avg((F.abs(err) <= 10).cast("double")).alias("within_10"),
        F.min((F.abs(F.col("raw") - p) <= 1e-8 + 1e-5 * F.abs(p)).cast("int")).alias("legal_raw"))
    return scored


# Clinical context columns, absent ones count as 0.
CONTEXT_CONDITIONS = "has_htn has_ihd has_hf has_afib has_tachy has_brady has_cad".split()
CONTEXT_DRUGS = ("on_ace on_arb on_bb on_ndhp_ccb on_loop on_thiazide on_mra on_nitrate on_antiarr on_nsaid").split()
ANTIHYPERTENSIVE = "on_ace on_arb on_bb on_ndhp_ccb on_loop on_thiazide on_mra".split()
HISTORY = ("hist_n hist_mean hist_sd hist_q25 hist_q50 hist_q75 hist_q90 hist_iqr hist_min hist_max recent_mean10 "
           "recent_sd10 recent_slope20 level_vs_cohort age is_male cohort_prior").split()


def cut_frame(panel: DataFrame, cohort: DataFrame, every: DataFrame, config: Config = Config(), value="sbp") -> DataFrame:
    """One row per (series, cut): statistics of the first c rows and the q0.90 of the next 30.

    ``cohort`` and ``every`` come from :func:`priors` at one warm-up length and quantile. Only the first
    ``max(cuts) + future`` rows of a series are read, so every group is small whatever the series length.
    """
    q = q_name(config.quantile)
    reach = max(config.cuts) + config.future
    v = F.col(value).cast("double")
    have = set(panel.columns)
    flags = [c for c in [*CONTEXT_CONDITIONS, *CONTEXT_DRUGS, "took_all_meds"] if c in have]
    rows = panel.where(F.col("step") < reach).select(
        KEY, "step", v.alias("v"), "patient_split", "is_dm", "is_male",
        F.coalesce(F.col("age"), F.lit(65.0)).alias("age"), cohort_key("age", "is_male").alias("cohort_key"),
        *[F.col(c).cast("double").alias(c) for c in flags])
    each = rows.select("*", F.explode(F.array(*[F.lit(c) for c in config.cuts])).alias("cut")).where(
        F.col("step") < F.col("cut") + config.future)
    past, cut = F.col("step") < F.col("cut"), F.col("cut")
    # Positions among known past values, counted from the cut backwards: rows are few, so a window is cheap.
    back = Window.partitionBy(KEY, "cut").orderBy(F.col("_known").desc(), F.col("step").desc())
    each = each.withColumn("_known", (past & F.col("v").isNotNull()).cast("int"))
    each = each.withColumn("_back", F.when(F.col("_known") == 1, F.row_number().over(back)))
    h = F.when(F.col("_known") == 1, F.col("v"))
    t10 = F.when(F.col("_back") <= 10, F.col("v"))
    t20 = F.when(F.col("_back") <= 20, F.col("v"))
    future = F.when(~past, F.col("v"))
    first = F.min_by(F.struct("patient_split", "is_dm", "is_male", "age", "cohort_key"), F.col("step")).alias("_s")
    aggs = [first, F.max("step").alias("_last"), F.count(h).alias("_past"), F.count(future).alias("_future"),
            F.avg(h).alias("hist_mean"), F.stddev_samp(h).alias("hist_sd"),
            F.percentile(h, F.array(*[F.lit(p) for p in (.25, .5, .75, .9)])).alias("_q"),
            F.min(h).alias("hist_min"), F.max(h).alias("hist_max"), F.avg(t10).alias("recent_mean10"),
            F.stddev_samp(t10).alias("recent_sd10"),
            F.when(F.count(t20) >= 5, F.regr_slope(t20, -F.col("_back").cast("double"))).alias("recent_slope20"),
            F.percentile(future, F.lit(config.quantile)).alias("y")]
    aggs += [F.max(F.when(past, F.col(c))).alias(f"clin_{c}") for c in flags if c != "took_all_meds"]
    if "took_all_meds" in have:
        known_back = F.row_number().over(Window.partitionBy(KEY, "cut").orderBy(
            (past & F.col("took_all_meds").isNotNull()).cast("int").desc(), F.col("step").desc()))
        each = each.withColumn("_med", known_back)
        aggs.append(F.avg(F.when(past & (F.col("_med") <= 30), F.col("took_all_meds"))).alias("_adherence"))
    g = each.groupBy(KEY, "cut").agg(*aggs).where(
        (F.col("_last") + 1 >= cut + 10) & (F.col("_past") >= 5) & (F.col("_future") >= 8))
    g = g.select(KEY, "cut", "_s.*", *[c for c in g.columns if c not in (KEY, "cut", "_s", "_q", "_last", "_future")],
                 *[F.col("_q")[i].alias(n) for i, n in enumerate(("hist_q25", "hist_q50", "hist_q75", "hist_q90"))])
    # Priors have one row per cohort, at most eight.
    g = (attach_row(g.join(F.broadcast(cohort.drop("warm")), "cohort_key", "left"), every.drop("warm"))
         .withColumn("cohort_prior", F.coalesce(f"cohort_{q}", f"global_{q}")))
    g = (g.withColumn("hist_n", F.col("_past").cast("double")).withColumn("hist_iqr", F.col("hist_q75") - F.col("hist_q25"))
         .withColumn("level_vs_cohort", F.col("hist_q90") - F.col("cohort_prior"))
         .withColumn("age", F.col("age").cast("double")).withColumn("is_male", F.col("is_male").cast("double")))
    clin = {c: (F.coalesce(F.col(f"clin_{c}"), F.lit(0.0)) if c in flags else F.lit(0.0))
            for c in [*CONTEXT_CONDITIONS, *CONTEXT_DRUGS]}
    total = lambda names: sum((clin[c] for c in names), F.lit(0.0))
    adherence = F.coalesce(F.col("_adherence"), F.lit(1.0)) if "took_all_meds" in have else F.lit(1.0)
    return g.select(KEY, "cut", "patient_split", "is_dm", "cohort_key", "y", *HISTORY,
                    *[c.alias(f"clin_{n}") for n, c in clin.items()], total(CONTEXT_DRUGS).alias("clin_n_medications"),
                    total(ANTIHYPERTENSIVE).alias("clin_n_antihypertensive"), adherence.alias("clin_adherence"))


OFFSET_FEATURES = [*HISTORY, *[f"clin_{c}" for c in [*CONTEXT_CONDITIONS, *CONTEXT_DRUGS]], "clin_n_medications",
                   "clin_n_antihypertensive", "clin_adherence"]


def offset_split(frame: DataFrame, salt: str = "offset-split") -> DataFrame:
    """Entity-disjoint train, calib and select; the global holdout is kept."""
    b = bucket(KEY, salt)
    return frame.withColumn("offset_split", F.when(F.col("patient_split") == "holdout", "holdout")
                            .when(b < 20, "calib").when(b < 40, "select").otherwise("train"))


def fit_bayes_blend(train: DataFrame, bound: int | None = None) -> DataFrame:
    """Shrinkage constant as a variance ratio, and a median bias: one row (k, bias)."""
    p, c, y = F.col("hist_q90"), F.col("cohort_prior"), F.col("y")
    known = train.where(p.isNotNull() & c.isNotNull() & y.isNotNull()).select((y - p).alias("d"), (p - c).alias("s"))
    var = known.agg(F.coalesce(F.var_samp("d"), F.lit(1.0)).alias("sigma2"),
                    F.coalesce(F.var_samp("s"), F.lit(1.0)).alias("tau2"))
    bias = quantiles(known, [], "d", {"bias": 0.5}, bound)
    k = clip(F.col("sigma2") / F.greatest(F.col("tau2"), F.lit(1e-9)), 1.0, 400.0)
    return attach_row(var, bias).select(k.alias("k"), F.coalesce("bias", F.lit(0.0)).alias("bias"))


def predict_bayes_blend(frame: DataFrame, fitted: DataFrame, name="pred") -> DataFrame:
    n = F.coalesce(F.col("hist_n"), F.lit(0.0))
    w = n / (n + F.col("k"))
    personal = F.coalesce("hist_q90", "cohort_prior")
    return (attach_row(frame, fitted)
            .withColumn(name, w * personal + (1 - w) * F.col("cohort_prior") + F.col("bias")).drop("k", "bias"))


def reference_candidates(k: float, config: Config = Config()) -> dict[str, Column]:
    """What every learned threshold has to beat."""
    personal = F.coalesce("hist_q90", "cohort_prior")
    w = F.col("hist_n") / (F.col("hist_n") + k)
    return {"capped blend (reference)": w * personal + (1 - w) * F.col("cohort_prior"),
            "personal q90 only": personal, "cohort prior only": F.col("cohort_prior"),
            "population constant": F.lit(config.population_threshold)}


def pinball(y, p, q: float = 0.90) -> Column:
    d = y - p
    return F.greatest(q * d, (q - 1) * d)


def long_candidates(frame: DataFrame, candidates: dict[str, Column], family: dict[str, str],
                    config: Config = Config()) -> DataFrame:
    """One row per (frame row, candidate) with the capped prediction."""
    return frame.select(KEY, "cut", "offset_split", "y", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.lit(family.get(n, "learned")).alias("family"),
                 cap(c.cast("double"), config).alias("p")) for n, c in candidates.items()])))


def board(long: DataFrame, config: Config = Config(), least: int = 20) -> DataFrame:
    """Pinball loss, error, coverage and closeness per candidate on the select and holdout parts."""
    y, p = F.col("y"), F.col("p")
    g = long.where(F.col("offset_split").isin("select", "holdout")).groupBy("model", "family", "offset_split").agg(
        F.count("*").alias("n"), F.avg(pinball(y, p, config.quantile)).alias("pinball"),
        F.avg(F.abs(y - p)).alias("mae"), F.avg((y <= p).cast("double")).alias("coverage"),
        F.avg((F.abs(y - p) <= 10).cast("double")).alias("within10"))
    return g.where(F.col("n") >= least)
