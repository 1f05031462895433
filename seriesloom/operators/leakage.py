"""Audits that features never see the future; each probe is PASS, WARN or FAIL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.expr import finite
from seriesloom.functions.lanes import Lanes, attach_row, lay_out
from seriesloom.operators.contract import rows
from seriesloom.operators.features import LATENT
from seriesloom.operators.stats import correlation_matrix


def target_mismatches(frame: DataFrame, signal: str, horizons: Sequence[int], tolerance: float = 1e-3) -> DataFrame:
    """Is ``y_<signal>_h<h>`` at step t the value at step t + h? One equi-join for all horizons."""
    asked = frame.select("series_id", F.inline(F.array(*[
        F.struct(F.lit(h).alias("h"), (F.col("step") + h).alias("step"), F.col(f"y_{signal}_h{h}").alias("y"))
        for h in horizons])))
    actual = frame.select("series_id", "step", F.col(signal).alias("v"))
    off = F.col("y").isNull() | (F.abs(F.col("y") - F.col("v")) > tolerance)
    return (asked.join(actual, ["series_id", "step"]).groupBy("h")
            .agg(F.count("*").alias("n"), F.count_if(off).alias("mismatches")))


def structural_audit(frame: DataFrame, features: Sequence[str], signal="sbp", horizons=(0, 1, 2), key="series_id",
                     before: str | None = None) -> DataFrame:
    """Copies of the current value, exact lags, split order, holdout, infinities, coverage, density, latent columns.

    ``before`` names a column with the previous row's value, where the caller's window has it already.
    """
    features = [f for f in features if f in frame.columns]
    lagged = frame
    if before is None:
        lanes = lay_out(frame.select(key, "step", signal, f"{signal}_lag1"), [key], ["step"], reach=1)
        lagged, before = lanes.done(lanes.df.withColumn("_before", F.lag(signal).over(lanes.window))), "_before"
    l, v = F.col(f"{signal}_lag1"), F.col(before)
    same = l.eqNullSafe(v) | F.coalesce(F.abs(l - v) <= 1e-3, F.lit(False))
    lagged = lagged.where("step > 0").agg(F.count_if(~same).alias("lag_off"))
    order = frame.groupBy(key).agg(
        *[F.max(F.when(F.col("split") == s, F.col("step"))).alias(f"hi_{s}") for s in ("train", "val", "test")],
        *[F.min(F.when(F.col("split") == s, F.col("step"))).alias(f"lo_{s}") for s in ("train", "val", "test")],
        (F.min("patient_split") != F.max("patient_split")).alias("mixed")).agg(
        F.count_if((F.col("hi_train") >= F.col("lo_val")) | (F.col("hi_val") >= F.col("lo_test"))).alias("disorder"),
        F.count_if("mixed").alias("mixed"))
    inf = lambda c: F.abs(F.col(c).cast("double")) == float("inf")
    one = frame.agg(
        F.count_if(F.col(f"{signal}_mean3").isNotNull() & F.col(f"{signal}_lag1").isNull()).alias("early"),
        F.max(F.array_max(F.array(F.lit(0), *[F.coalesce(inf(f), F.lit(False)).cast("int") for f in features]))).alias("inf"),
        *[F.avg(F.col(f"y_{signal}_h{h}").isNotNull().cast("double")).alias(f"cov{h}") for h in horizons],
        *[F.count(f).alias(f"_n{i}") for i, f in enumerate(features)], F.count("*").alias("_rows"))
    one = one.withColumn("density", F.array_min(F.array(*[F.col(f"_n{i}") for i in range(len(features))])) / F.col("_rows"))
    twins = correlation_matrix(frame, [*features, signal], last=1).where(F.col("b") == signal).agg(
        F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("copy"))
    one = attach_row(attach_row(attach_row(one, twins), lagged), order)
    c = F.col
    latent = sorted(set(LATENT) & set(features))
    return rows(one, [
        ("no feature is a copy of the current value", c("copy") < 0.999, c("copy"), True),
        ("lag 1 equals the previous row", c("lag_off") == 0, c("lag_off"), True),
        ("no rolling feature precedes its first lag", c("early") == 0, c("early"), True),
        ("train precedes val precedes test", c("disorder") == 0, c("disorder"), True),
        ("entity split is disjoint", c("mixed") == 0, c("mixed"), True),
        ("no infinite values", c("inf") == 0, c("inf"), True),
        *[(f"target h{h} present", c(f"cov{h}") > 0.5, c(f"cov{h}"), True) for h in horizons],
        ("every feature known on 30% of rows", c("density") > 0.30, c("density"), False),
        ("latent variables are not features", F.lit(not latent), F.lit(float(len(latent))), True)])


def future_corruption(lanes: Lanes, df: DataFrame, build: Callable[[Lanes, DataFrame], DataFrame], features: Sequence[str], value="sbp",
                      shift: float = 50.0, tolerance: float = 1e-6) -> DataFrame:
    """Raise the second half of every series and rebuild: no feature of the first half may move.

    ``build`` adds features to laid-out rows and keeps their lanes. Both variants are built in the same lanes, one after
    the other, and compared within the row, so nothing is joined. One row per feature with the number of moved cells.
    """
    half = lanes.whole(df, _last=F.max("step")).withColumn("_mid", F.floor((F.col("_last") + 1) / 2)).drop("_last")
    values = F.array(*[finite(f) for f in features])
    first = build(lanes, half).select(*half.columns, values.alias("_first"))
    bent = first.withColumn(value, F.when(F.col("step") >= F.col("_mid"), F.col(value) + shift).otherwise(F.col(value)))
    both = lanes.done(build(lanes, bent)).where(F.col("step") < F.col("_mid")).select("_first", values.alias("_second"))
    same = lambda a, b: a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance + tolerance * F.abs(b), F.lit(False))
    one = both.agg(F.count("*").alias("n"), *[F.count_if(~same(F.col("_first")[i], F.col("_second")[i])).alias(f"m{i}") for i in range(len(features))])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("n_moved")) for i, f in enumerate(features)])))


def label_reproduction(lanes: Lanes, frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Symptom features must not reproduce their own label; same-day columns equal today, not tomorrow."""
    suffixes = ("_rate30", "_mean30", "_mean7", "_lag1")
    pairs = []
    for f in features:
        stem = next((f[: -len(s)] for s in suffixes if f.endswith(s)), f)
        if f.startswith("sym_") and stem != f and stem in frame.columns:
            pairs.append((f, stem))
    today = [(f, f[len("adh_"):-len("_today")]) for f in features if f.startswith("adh_") and f.endswith("_today")]
    d = frame.select("*", *[F.lead(raw).over(lanes.window).alias(f"_next_{raw}") for _, raw in today])
    one = lanes.done(d).agg(
        *[F.abs(F.corr(f, raw)).alias(f"r_{f}") for f, raw in pairs],
        *[F.count_if(~F.col(f).eqNullSafe(F.col(raw))).alias(f"e_{f}") for f, raw in today],
        *[F.abs(F.corr(f, f"_next_{raw}")).alias(f"n_{f}") for f, raw in today])
    checks = [(f"{f} does not reproduce {raw}", F.coalesce(F.col(f"r_{f}"), F.lit(0.0)) < 0.95, F.col(f"r_{f}"), True)
              for f, raw in pairs]
    checks += [(f"{f} reads today, not tomorrow", (F.col(f"e_{f}") == 0) & (F.coalesce(F.col(f"n_{f}"), F.lit(0.0)) < 0.95),
                F.col(f"n_{f}"), True) for f, _ in today]
    return rows(one, checks)


def shuffled_target(train: DataFrame, target: str, row_keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Targets dealt out at random: the i-th row by one hash gets the target of the i-th row by another."""
    rank = lambda s, extra: lay_out(
        train.select(F.lit(0).alias("_all"), *row_keys, *extra, F.xxhash64(*row_keys, F.lit(s)).alias("_h")),
        ["_all"], ["_h", *row_keys])
    a = rank(seed, [])
    b = rank(seed + 1, [F.col(target).alias("y_shuffled")])
    left = a.done(a.df).select(*row_keys, "step")
    right = b.done(b.df).select("step", "y_shuffled")
    dealt = left.withColumnRenamed("step", "_i").join(right.withColumnRenamed("step", "_i"), "_i").drop("_i")
    return train.join(dealt, list(row_keys))


def last_row_coverage(rows_: DataFrame, features: Sequence[str], inputs: Sequence[str], collected: Sequence[str],
                      key="series_id") -> DataFrame:
    """Which features of each newest row are missing, and what would fill them: input, history, or nothing."""
    from seriesloom.operators.features import unpivot
    long = unpivot(rows_, features, keep=[key])
    stem = F.regexp_replace("feature", r"_(lag|mean|std|min|max|range|slope|ewm|rate)\d+$|_(z|d1|base_mean|base_std|excess_base|vol_ratio|ewm_resid|mom_3_14)$", "")
    fix = (F.when(F.col("value").isNotNull(), "resolved").when(stem.isin(*inputs), "more history")
           .when(stem.isin(*collected), "input").otherwise("never collected"))
    return long.select(key, fix.alias("state")).groupBy(key, "state").agg(F.count("*").alias("n"))
