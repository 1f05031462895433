"""Distribution statistics: correlations, ranks, KS, PSI, drift, variance shares, autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.config import STALE_DAYS
from seriesloom.functions.expr import clip, finite, first_of, half_even
from seriesloom.functions.lanes import LANE_ROWS, Lanes, attach_row, lay_out
from seriesloom.functions.quantile import quantiles
from seriesloom.functions.ranks import rank_products
from seriesloom.operators.features import unpivot

RANGE_LANES = 4          # counts that one task adds up for rank correlations, in lanes


def correlation_matrix(df: DataFrame, columns: Sequence[str], last: int | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation of any number of columns in one scan: rows (a, b, n, r), a < b.

    Every task adds up the Gram matrices of its batches and emits one row per pair; centring on the
    column means first keeps the sums small. With ``last``, only pairs whose ``b`` is one of the last ``last`` columns are made.
    """
    columns = list(columns)
    p = len(columns)
    from_b = 0 if last is None else p - last
    means = df.agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    centred = attach_row(df.select(*[finite(c).alias(f"c{i}") for i, c in enumerate(columns)]), means).select(
        *[(F.col(f"c{i}") - F.col(f"m{i}")).alias(f"c{i}") for i in range(p)])
    upper_a, upper_b = np.triu_indices(p, 1)
    upper_a, upper_b = upper_a[upper_b >= from_b], upper_b[upper_b >= from_b]

    def gram(batches):
        n, x, s_a, q_a, s_b, q_b = (np.zeros((p, p - from_b)) for _ in range(6))
        seen = False
        for pdf in batches:
            raw = pdf.to_numpy(dtype=float)
            known = ~np.isnan(raw)
            v, m = np.where(known, raw, 0.0), known.astype(float)
            v_b, m_b = v[:, from_b:], m[:, from_b:]
            n += m.T @ m_b
            s_a += v.T @ m_b
            q_a += (v * v).T @ m_b
            if from_b:
                s_b += m.T @ v_b
                q_b += m.T @ (v_b * v_b)
            x += v.T @ v_b
            seen = seen or len(pdf) > 0
        if seen:
            if not from_b:
                s_b, q_b = s_a.T, q_a.T
            i, j = upper_a, upper_b - from_b
            yield pd.DataFrame(dict(i=upper_a.astype("int32"), j=upper_b.astype("int32"), n=n[i, j], sx=s_a[i, j], sy=s_b[i, j],
                                    qx=q_a[i, j], qy=q_b[i, j], xy=x[i, j]))

    parts = centred.mapInPandas(gram, "i int, j int, n double, sx double, sy double, qx double, qy double, xy double")
    g = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "xy")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    cov = F.col("xy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("qx") - F.col("sx") * F.col("sx") / n, F.col("qy") - F.col("sy") * F.col("sy") / n
    name = F.array(*[F.lit(c) for c in columns])
    # What rounding leaves of a constant column's variance is no variance.
    r = F.when((vx > 1e-12 * F.col("qx")) & (vy > 1e-12 * F.col("qy")), cov / F.sqrt(vx * vy))
    return g.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.col("n").cast("long").alias("n"),
                    clip(r, -1.0, 1.0).alias("r"))


def spearman(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Rank correlation of every feature with every target over the rows where both are known.

    Blocks of rows ask for the ranks of their values, so that each value is shuffled once per column and not once per pair.
    """
    features, targets = list(features), list(targets)
    sums, n = rank_products(df, [finite(f) for f in features], [finite(t) for t in targets], RANGE_LANES * LANE_ROWS)
    if sums is None:
        return df.sparkSession.createDataFrame([], "feature string, target string, n long, rho double")
    n_t = len(targets)
    name = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))
    return sums.select(name(features, F.floor(F.col("_pair") / n_t)).alias("feature"), name(targets, F.col("_pair") % n_t).alias("target"),
                       name(n.ravel().tolist(), F.col("_pair")).cast("long").alias("n"),
                       F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"))


def pearson(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Feature x target correlations as plain aggregates of one scan."""
    one = df.agg(*[F.corr(finite(f), finite(t)).alias(f"r{i}_{j}") for i, f in enumerate(features)
                   for j, t in enumerate(targets)],
                 *[F.count(finite(f) + finite(t)).alias(f"n{i}_{j}") for i, f in enumerate(features)
                   for j, t in enumerate(targets)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f"n{i}_{j}").alias("n"),
                 F.col(f"r{i}_{j}").alias("r")) for i, f in enumerate(features) for j, t in enumerate(targets)])))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Density, null share and whether the column holds more than one value."""
    one = df.agg(*[F.avg(finite(c).isNotNull().cast("double")).alias(f"d_{c}") for c in columns],
                 *[F.min(finite(c)).alias(f"lo_{c}") for c in columns], *[F.max(finite(c)).alias(f"hi_{c}") for c in columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"d_{c}").alias("density"), (1 - F.col(f"d_{c}")).alias("missing"),
                 F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False)).alias("varies")) for c in columns])))


def static_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns that never change inside a series: least and greatest value agree in every series."""
    per = df.groupBy(key).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    one = per.agg(*[F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in columns])
    return unpivot(one, columns, "feature", "varies").select("feature", (F.col("varies") == 0).alias("is_static"))


def describe(df: DataFrame, columns: Sequence[str], bound: int | None = None) -> DataFrame:
    """Count, mean, deviation, bias-corrected skewness and kurtosis, missing share, quartiles."""
    long = unpivot(df, columns).withColumn("value", finite("value"))
    n = F.count("value")
    g = long.groupBy("feature").agg(
        n.alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.skewness("value").alias("_sk"), F.kurtosis("value").alias("_ku"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    c = F.col("n").cast("double")
    g = g.withColumn("skew", F.col("_sk") * F.sqrt(c * (c - 1)) / (c - 2)).withColumn(
        "kurt", (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * F.col("_ku") + 6))
    q = quantiles(long, ["feature"], "value", {"q25": .25, "q50": .5, "q75": .75}, bound)
    return g.drop("_sk", "_ku").join(q, "feature")


def ks_two_sample(base: DataFrame, current: DataFrame, columns: Sequence[str], alpha: float = 0.05,
                  bound: int | None = None) -> DataFrame:
    """Two-sample KS statistic and asymptotic p-value per column."""
    both = (unpivot(base, columns).withColumn("_a", F.lit(1)).unionByName(unpivot(current, columns).withColumn("_a", F.lit(0))))
    cells = both.where(finite("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("_a").alias("_x"), F.sum(1 - F.col("_a")).alias("_y"))
    lanes = lay_out(cells, ["feature"], ["value"], bound=bound)
    ran = lanes.running(lanes.df, _cx=("sum", F.col("_x")), _cy=("sum", F.col("_y")))
    ran = lanes.done(lanes.whole(ran, _nx=F.sum("_x"), _ny=F.sum("_y")))
    gap = F.abs(F.try_divide(F.col("_cx").cast("double"), F.col("_nx")) - F.try_divide(F.col("_cy").cast("double"), F.col("_ny")))
    g = ran.groupBy("feature").agg(F.max("_nx").alias("n_base"), F.max("_ny").alias("n_current"), F.max(gap).alias("statistic"))
    lam = F.sqrt(F.col("n_base") * F.col("n_current") / (F.col("n_base") + F.col("n_current"))) * F.col("statistic")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0)
                        * F.exp(-2.0 * k * k * F.col("_lam") * F.col("_lam")))
    p = F.when(F.col("_lam") < 0.2, F.lit(1.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))
    return (g.withColumn("_lam", lam).withColumn("p_value", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).drop("_lam")
            .withColumn("drift", F.col("p_value") < alpha))


def psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, bound: int | None = None) -> DataFrame:
    """Population stability index per column, edges from reference quantiles, null for thin columns."""
    ref = unpivot(reference, columns).where(finite("value").isNotNull())
    cur = unpivot(current, columns).where(finite("value").isNotNull())
    edges = quantiles(ref, ["feature"], "value", {f"e{i}": i / bins for i in range(bins + 1)}, bound)
    every = F.array_sort(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(bins + 1)])))
    edges = edges.select("feature", F.slice(every, F.lit(2), F.greatest(F.size(every) - 2, F.lit(0))).alias("_inner"),
                         F.size(every).alias("_edges"))
    both = ref.withColumn("_r", F.lit(1)).unionByName(cur.withColumn("_r", F.lit(0)))
    # Edges: one short list per column.
    binned = both.join(F.broadcast(edges), "feature").select(
        "feature", "_edges", "_r", F.size(F.filter("_inner", lambda e: e <= F.col("value"))).alias("_bin"))
    counts = binned.groupBy("feature", "_edges", "_bin").agg(F.sum("_r").alias("_e"), F.sum(1 - F.col("_r")).alias("_a"))
    totals = counts.groupBy("feature").agg(F.sum("_e").alias("_ne"), F.sum("_a").alias("_na"))
    j = counts.join(totals, "feature")
    pe = F.greatest(F.col("_e") / F.col("_ne"), F.lit(1e-6))
    pa = F.greatest(F.try_divide(F.col("_a").cast("double"), F.col("_na")), F.lit(1e-6))
    # Inner bins without any row on either side contribute nothing: both shares clip to the same floor.
    return (j.where((F.col("_ne") >= 50) & (F.col("_na") >= 50) & (F.col("_edges") >= 3))
            .groupBy("feature").agg(F.sum((pa - pe) * F.log(pa / pe)).alias("psi")))


def psi_status(psi_col="psi", warn=0.10, alarm=0.20) -> Column:
    return first_of((F.col(psi_col) >= alarm, "ALARM"), (F.col(psi_col) >= warn, "WARN"), default="ok")


def drift_report(scores: DataFrame) -> DataFrame:
    """Every column with its status and its rank, 1 for the one that moved most; there is one row per column."""
    order = Window.orderBy(F.col("psi").desc(), "feature")
    return scores.withColumn("status", psi_status()).withColumn("rank", F.row_number().over(order))


def rate_drift(observed, target, tolerance: float, two_sided: bool) -> tuple[Column, Column]:
    rel = (F.col(observed) - F.col(target)) / F.greatest(F.col(target), F.lit(1e-9))
    rel = F.abs(rel) if two_sided else rel
    return half_even(rel, 3), F.when(rel > tolerance, "ALARM").otherwise("ok")


def response(status) -> Column:
    return F.when(F.col(status) == "ALARM", "recalibrate, then refit if that fails, then roll back").otherwise(
        "no action; continue monitoring")


def variance_shares(df: DataFrame, key: str, value: str, least: int = 10) -> DataFrame:
    """Between and within variation, the share between, and the one-way ANOVA F over series."""
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull()).groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"),
                                                   F.var_pop(v).alias("vp"))
    spread = per.agg(F.stddev_samp("m").alias("between_sd"), F.avg("s").alias("within_sd"))
    big = per.where(F.col("n") > least)
    grand = big.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    a = attach_row(big, grand).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("ssb"),
        F.sum(F.col("n") * F.col("vp")).alias("ssw"), F.count("*").alias("k"), F.sum("n").alias("n"))
    b, w = F.col("between_sd"), F.col("within_sd")
    return attach_row(spread, a).select(
        "between_sd", "within_sd", (b * b / (b * b + w * w)).alias("between_share"),
        ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("anova_f"))


def autocorrelation(lanes: Lanes, df: DataFrame, value: str, max_lag: int = 20, least: int = 40) -> DataFrame:
    """Mean autocorrelation per lag over series with enough rows. Lanes need a reach of ``max_lag``."""
    v = F.col(value).cast("double")
    d = lanes.whole(df, _mean=F.avg(v), _n=F.count(v)).withColumn("_y", v - F.col("_mean"))
    lagged = d.select(*lanes.key, "_n", "_y", *lanes.part[len(lanes.key):], *(["_echo"] if lanes.split else []),
                      *[F.lag("_y", k).over(lanes.window).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    rows = lanes.done(lagged).where(F.col("_n") >= least)
    per = rows.groupBy(*lanes.key).agg(F.sum(F.col("_y") * F.col("_y")).alias("_d"),
                                       *[F.sum(F.col("_y") * F.col(f"_l{k}")).alias(f"a{k}") for k in range(1, max_lag + 1)])
    mean = per.where(F.col("_d") > 0).agg(F.count("*").alias("n_series"), *[
        F.avg(F.col(f"a{k}") / F.col("_d")).alias(f"a{k}") for k in range(1, max_lag + 1)])
    return mean.select("n_series", F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("acf")) for k in range(1, max_lag + 1)])))


def lag_one_r2(lanes: Lanes, df: DataFrame, value: str, least: int = 30) -> DataFrame:
    """Squared correlation with the previous row per series."""
    d = df.select("*", F.lag(value).over(lanes.window).alias("_prev"))
    g = lanes.done(d).groupBy(*lanes.key).agg(F.count(value).alias("n"), F.corr(value, "_prev").alias("_r"))
    return g.where(F.col("n") > least).select(*lanes.key, (F.col("_r") * F.col("_r")).alias("r2"))


def pooled_vs_within(lanes: Lanes, df: DataFrame, a: str, b: str, max_lag: int = 3) -> DataFrame:
    """Pooled and within-series correlation at each lag of ``b`` behind ``a``, and the gap between them."""
    d = lanes.whole(df, _ma=F.avg(a), _mb=F.avg(b))
    d = d.select(*d.columns, *[F.lag(b, k).over(lanes.window).alias(f"_b{k}") for k in range(1, max_lag + 1)])
    rows = lanes.done(d).withColumn("_b0", F.col(b))
    one = rows.agg(*[F.corr(a, f"_b{k}").alias(f"p{k}") for k in range(max_lag + 1)],
                   *[F.corr(F.col(a) - F.col("_ma"), F.col(f"_b{k}") - F.col("_mb")).alias(f"w{k}") for k in range(max_lag + 1)])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(k).alias("lag"), F.col(f"p{k}").alias("pooled"), F.col(f"w{k}").alias("within"),
        (F.col(f"p{k}") - F.col(f"w{k}")).alias("artefact")) for k in range(max_lag + 1)])))


def odds_ratio(df: DataFrame, outcome: Column, exposure: Column) -> DataFrame:
    """2 x 2 odds ratio with half a count added to every cell."""
    n = lambda y, x: F.count_if(y & x) + 0.5
    return df.agg((n(outcome, exposure) * n(~outcome, ~exposure) / (n(outcome, ~exposure) * n(~outcome, exposure)))
                  .alias("odds_ratio"))


def pressure_reference(df: DataFrame, sbp="sbp", dbp="dbp", bound: int | None = None) -> DataFrame:
    """Quantiles of the pulse pressure and of its distance from the median: one row."""
    pp = df.select((F.col(sbp).cast("double") - F.col(dbp)).alias("pp")).where(finite("pp").isNotNull())
    q = quantiles(pp, [], "pp", {"pp_p001": 0.001, "pp_p50": 0.5, "pp_p999": 0.999}, bound)
    dev = attach_row(pp, q.select("pp_p50")).select(F.abs(F.col("pp") - F.col("pp_p50")).alias("dev"))
    d = quantiles(dev, [], "dev", {"pp_abs_dev_p99": 0.99}, bound)
    return attach_row(attach_row(q, d), pp.agg(F.count("*").alias("n")))


def stale_share(df: DataFrame, gap="days_since_last_raw") -> Column:
    return F.avg((F.col(gap) > STALE_DAYS).cast("double"))
