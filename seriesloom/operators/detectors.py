"""Early-warning detectors: event labels, causal scores, fusion, scorecards, tuning and abstention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions.expr import clip, finite, ratio
from seriesloom.functions.lanes import Lanes, attach_row
from seriesloom.functions.quantile import quantiles
from seriesloom.functions.skew import attach
from seriesloom.lineage import pin
from seriesloom.operators.features import unpivot
from seriesloom.operators.metrics import ranking

REFERENCE = "d_fixed_threshold"


def event_thresholds(rows: DataFrame, key="series_id", value="sbp", q=0.95, bound: int | None = None) -> DataFrame:
    """Personal event threshold from train rows."""
    return quantiles(rows.where(F.col("split") == "train"), [key], value, {"event_threshold": q}, bound)


def label_events(lanes: Lanes, df: DataFrame, value="sbp", window: int = 3) -> DataFrame:
    """1 if any of the next values reaches the threshold, 0 only if all were seen, else null; first hit step."""
    ahead = [F.lead(value, i).over(lanes.window) for i in range(1, window + 1)]
    names = [f"_f{i}" for i in range(1, window + 1)]
    df = df.select("*", *[a.alias(n) for a, n in zip(ahead, names)])
    thr = F.col("event_threshold")
    hit = F.greatest(*[F.coalesce((F.col(n) >= thr).cast("int"), F.lit(0)) for n in names])
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    first = F.coalesce(*[F.when(F.col(n) >= thr, F.col("step") + i + 1) for i, n in enumerate(names)])
    label = F.when(thr.isNull(), None).when(hit == 1, 1).when(complete, 0)
    return df.withColumn("event_next", label).withColumn("event_step", first).drop(*names)


def column_scores(s="sbp") -> list[Column]:
    """Closed-form scores over features."""
    c = lambda n: F.col(f"{s}_{n}")
    return [F.abs(c("z")).alias("d_personal_z"), ratio(F.abs(c("lag1") - c("ewm10")), c("base_std")).alias("d_ewma_gap"),
            c("slope7").alias("d_slope7"), (c("mean7") - c("base_mean")).alias("d_mean7_excess"),
            c("lag1").alias(REFERENCE)]


def cusum(lanes: Lanes, df: DataFrame, x: str, ks: dict[str, float], head: int = 20) -> DataFrame:
    """One-sided CUSUM on values standardised by the first ``head`` rows; a null resets it to 0.

    max(0, acc + v) equals a running sum minus its running minimum since the last reset; the minimum is
    taken over (reset number descending, sum), so a later reset always wins. Several k share the windows.
    """
    v = F.col(x).cast("double")
    first = F.when(F.col("step") < head, v)
    names = df.columns
    d = lanes.whole(df, _m=F.avg(first), _s=F.stddev_pop(first), _ma=F.avg(v), _sa=F.stddev_pop(v))
    sd = F.coalesce(F.when(F.col("_s") > 0, F.col("_s")), F.when(F.col("_s").isNotNull() & (F.col("_sa") > 0), F.col("_sa")),
                    F.lit(1.0))
    d = d.withColumn("_z", (v - F.coalesce("_m", "_ma")) / sd)
    sums = {f"_g{i}": ("sum", F.coalesce(F.col("_z") - k, F.lit(0.0))) for i, k in enumerate(ks.values())}
    d = lanes.running(d, _seg=("count", F.when(F.col("_z").isNull(), 1)), **sums)
    lows = {f"_low{i}": ("min", F.struct((-F.col("_seg")).alias("a"), F.col(f"_g{i}").alias("b"))) for i in range(len(ks))}
    d = lanes.running(d, **lows)
    out = []
    for i, name in enumerate(ks):
        low = F.col(f"_low{i}.b")
        floor = F.when(F.col("_seg") == 0, F.least(low, F.lit(0.0))).otherwise(low)
        out.append((F.col(f"_g{i}") - floor).alias(name))
    return d.select(*names, *out)


def page_hinkley(lanes: Lanes, df: DataFrame, x: str, deltas: dict[str, float]) -> DataFrame:
    """Departure of the running sum of (x - running mean - delta) from its minimum; a null carries the last value."""
    names = df.columns
    v = F.col(x).cast("double")
    d = lanes.running(df, _n=("count", v), _sum=("sum", v))
    d = d.withColumn("_mu", F.try_divide("_sum", "_n"))
    d = lanes.running(d, **{f"_t{i}": ("sum", v - F.col("_mu") - dl) for i, dl in enumerate(deltas.values())})
    d = lanes.running(d, **{f"_low{i}": ("min", F.when(v.isNotNull(), F.col(f"_t{i}"))) for i in range(len(deltas))})
    return d.select(*names, *[F.coalesce(F.col(f"_t{i}") - F.col(f"_low{i}"), F.lit(0.0)).alias(n)
                              for i, n in enumerate(deltas)])


def forecast_scores(df: DataFrame, forecast: str, key="series_id", value="sbp", bound: int | None = None) -> DataFrame:
    """Forecast against the series' own train mean and deviation, and against its event threshold."""
    own = df.where(F.col("split") == "train").groupBy(key).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    out = attach(df, own, key, bound=bound)
    return (out.withColumn("d_forecast_level", ratio(F.col(forecast) - F.col("_mu"), F.col("_sd")))
            .withColumn("d_forecast_breach", F.col(forecast) - F.col("event_threshold")).drop("_mu", "_sd"))


def fuse(df: DataFrame, detectors: Sequence[str], weights: dict[str, float] | None = None, least: int = 50) -> DataFrame:
    """Standardise every detector on train rows, clip at 8, then combine: mean, median, max, trimmed, weighted.

    The trimmed mean drops the lowest and highest leg that is present, when at least four are.
    """
    legs = [d for d in detectors if d != REFERENCE]
    train = df.where(F.col("split") == "train").agg(
        *[F.count(finite(c)).alias(f"_n_{c}") for c in legs], *[F.avg(finite(c)).alias(f"_m_{c}") for c in legs],
        *[F.stddev_samp(finite(c)).alias(f"_s_{c}") for c in legs])
    z = {c: F.when(F.col(f"_n_{c}") >= least, clip(
        (finite(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)), -8.0, 8.0))
        for c in legs}
    d = attach_row(df, train).withColumn("_z", F.array_sort(F.array_compact(F.array(*z.values()))))
    n = F.size("_z")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
    mean = F.when(n > 0, total(F.col("_z")) / n)
    half = F.floor((n - 1) / 2).cast("int")
    middle = F.when(n > 0, (F.try_element_at("_z", half + 1) + F.try_element_at("_z", F.floor(n / 2).cast("int") + 1)) / 2)
    trimmed = F.when(n >= 4, total(F.slice("_z", F.lit(2), F.greatest(n - 2, F.lit(0)))) / (n - 2)).otherwise(mean)
    weighted = mean
    if weights and sum(weights.values()) > 0:
        w = sum(weights.values())
        weighted = sum((F.coalesce(z[c], F.lit(0.0)) * (weights[c] / w) for c in weights), F.lit(0.0))
    out = d.select(*df.columns, mean.alias("d_fuse_mean"), middle.alias("d_fuse_median"),
                   F.try_element_at("_z", F.when(n > 0, n).otherwise(1)).alias("d_fuse_max"),
                   trimmed.alias("d_fuse_trimmed"), weighted.alias("d_fuse_weighted"))
    return out


def fusion_weights(df: DataFrame, detectors: Sequence[str], bound: int | None = None) -> dict[str, float]:
    """Average precision above the base rate on validation rows, floored at zero: one number per detector."""
    legs = [d for d in detectors if d != REFERENCE]
    val = df.where((F.col("split") == "val") & F.col("event_next").isNotNull())
    long = unpivot(val, legs, "detector", "score", ["event_next"])
    rows = ranking(long, ["detector"], "score", "event_next", bound).select("detector", "auc_pr", "base_rate").collect()
    return {r["detector"]: max(r["auc_pr"] - r["base_rate"], 0.0) for r in rows}      # one row per detector


def scorecard(df: DataFrame, detectors: Sequence[str], sessions_per_week: float, budgets=(1, 2, 5, 10),
              bound: int | None = None) -> DataFrame:
    """Precision, lift, recall, AUCs and lead time per detector and alert budget."""
    of_row = ["event_next", "event_step", "step", "days_since_last"]
    held = pin(df.where(F.col("event_next").isNotNull()).select(*of_row, *detectors))      # cuts, flags and ranking scan it
    long = unpivot(held, detectors, "detector", "score", of_row)
    long = long.withColumn("score", finite("score")).where(F.col("score").isNotNull())
    cuts = quantiles(long, ["detector"], "score", {f"b{b}": (100 - b) / 100.0 for b in budgets}, bound)
    cuts = cuts.select("detector", F.inline(F.array(*[
        F.struct(F.lit(b).alias("budget_pct"), F.col(f"b{b}").alias("cut")) for b in budgets])))
    # One row per detector and budget: a few dozen.
    flagged = long.join(F.broadcast(cuts), "detector")
    flag, y = F.col("score") >= F.col("cut"), F.col("event_next") == 1
    hit = flag & y
    lead = F.when(hit, (F.col("event_step") - F.col("step")).cast("double"))
    gap = F.when(hit, F.col("days_since_last"))
    # Leads are 1..window and gaps 1..30, so percentile keeps a handful of distinct values.
    g = flagged.groupBy("detector", "budget_pct").agg(
        F.count_if(hit).alias("tp"), F.count_if(flag & ~y).alias("fp"), F.count_if(~flag & y).alias("fn"),
        F.percentile(gap, F.lit(0.5)).alias("_gap"),
        F.percentile(lead, F.array(F.lit(.1), F.lit(.5), F.lit(.9))).alias("_lead"))
    g = g.join(F.broadcast(ranking(long, ["detector"], "score", "event_next", bound)), "detector")
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    return g.select(
        "detector", "budget_pct", "base_rate", precision.alias("precision"),
        F.try_divide(precision, F.col("base_rate")).alias("lift"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"), "auc_roc", "auc_pr",
        "auc_pr_lift", *[(F.col("_lead")[i] * F.col("_gap")).alias(f"lead_days_{n}") for i, n in enumerate(("p10", "median", "p90"))],
        (F.col("budget_pct") / 100.0 * sessions_per_week).alias("alerts_per_week"))


def ap_lifts(df: DataFrame, columns: Sequence[str], bound: int | None = None) -> DataFrame:
    """Validation AP lift of many score columns in one pass."""
    val = df.where((F.col("split") == "val") & F.col("event_next").isNotNull())
    return ranking(unpivot(val, columns, "candidate", "score", ["event_next"]), ["candidate"], "score", "event_next",
                   bound).select("candidate", "n", "auc_pr_lift")


def pick_tuned(lifts: DataFrame, families: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Best candidate per family; the default stays unless a candidate beats it."""
    rows = [(f, c, int(c == default), i) for f, (default, cands) in families.items() for i, c in enumerate([default, *cands])]
    plan = lifts.sparkSession.createDataFrame(rows, "family string, candidate string, is_default int, ord int")
    scored = plan.join(lifts, "candidate")
    best = F.max_by(F.struct("candidate", "auc_pr_lift", "is_default"),
                    F.struct(F.col("auc_pr_lift"), F.col("is_default"), -F.col("ord"))).alias("b")
    default = F.max(F.when(F.col("is_default") == 1, F.col("auc_pr_lift"))).alias("default_lift")
    return scored.groupBy("family").agg(best, default).select(
        "family", F.col("b.candidate").alias("candidate"), F.col("b.auc_pr_lift").alias("lift"), "default_lift",
        (F.col("b.is_default") == 0).alias("beat_default"))


def choose(report: DataFrame, budget: int, serveable: Sequence[str]) -> DataFrame:
    """The serveable detector with the highest average precision at the budget, never the reference."""
    ok = report.where((F.col("budget_pct") == budget) & F.col("detector").isin(*serveable) & (F.col("detector") != REFERENCE))
    return ok.orderBy(F.col("auc_pr").desc(), "detector").limit(1)


def serving_cut(df: DataFrame, detector: str, budget: float, bound: int | None = None) -> DataFrame:
    """The score above which ``budget`` percent of validation rows lie."""
    return quantiles(df.where(F.col("split") == "val"), [], detector, {"cut": 1 - budget / 100.0}, bound)


def timeline(df: DataFrame, detector: str, cut: DataFrame, warm: int = 7) -> DataFrame:
    """Flag per row, silent during the first ``warm`` rows of a series."""
    return attach_row(df, cut).withColumn("flagged", F.coalesce(
        (F.col("step") >= warm) & (F.col(detector) >= F.col("cut")), F.lit(False)))


def fit_abstention(train: DataFrame, columns: Sequence[str], bound: int | None = None) -> DataFrame:
    """Median and scaled MAD per column: one row per column."""
    long = unpivot(train, columns).where(F.col("value").isNotNull())
    med = quantiles(long, ["feature"], "value", {"median": 0.5}, bound)
    dev = long.join(F.broadcast(med), "feature").select("feature", F.abs(F.col("value") - F.col("median")).alias("dev"))
    mad = quantiles(dev, ["feature"], "dev", {"mad": 0.5}, bound)
    scale = F.greatest(F.coalesce(F.nullif(1.4826 * F.col("mad"), F.lit(0.0)), F.lit(1.0)), F.lit(1e-6))
    return med.join(mad, "feature").select("feature", "median", scale.alias("scale"))


def ood_distance(df: DataFrame, columns: Sequence[str], fitted: DataFrame, name="ood") -> DataFrame:
    """Mean absolute robust z over the columns that are present. One pivoted row of parameters travels along."""
    aggs = []
    for c in columns:
        of = F.col("feature") == c
        aggs += [F.max(F.when(of, F.col("median"))).alias(f"_md_{c}"), F.max(F.when(of, F.col("scale"))).alias(f"_sc_{c}")]
    wide = attach_row(df, fitted.agg(*aggs))
    z = F.array_compact(F.array(*[F.abs(F.col(c).cast("double") - F.col(f"_md_{c}")) / F.col(f"_sc_{c}") for c in columns]))
    total = F.aggregate(z, F.lit(0.0), lambda s, e: s + e)
    return wide.select(*df.columns, F.when(F.size(z) > 0, total / F.size(z)).alias(name))


def abstention(df: DataFrame, columns: Sequence[str], cut_q: float = 0.99, bound: int | None = None) -> DataFrame:
    """Rows with their distance and whether they lie past the train cut."""
    train = df.where(F.col("split") == "train")
    scored = ood_distance(df, columns, fit_abstention(train, columns, bound))
    cut = quantiles(scored.where(F.col("split") == "train"), [], "ood", {"ood_cut": cut_q}, bound)
    return attach_row(scored, cut).withColumn("abstains", F.coalesce(F.col("ood") > F.col("ood_cut"), F.lit(False)))
