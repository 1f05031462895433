"""Scores of forecasts, probabilities and detectors, all as aggregates over long tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions.expr import half_even
from seriesloom.functions.lanes import attach_row, lay_out
from seriesloom.functions.quantile import quantiles

#: Cumulative Poisson(1) probabilities; what lies beyond is less than one step of a draw's 31 bits.
POISSON_ONE = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))
PRIME = (1 << 31) - 1           # draws are linear hashes modulo this prime
GROUPS = 4096                   # groups that a task adds up before it hands them on
SLICE = 4096                    # rows that are weighted at once


def ranking(long: DataFrame, by: Sequence[str], score: str, label: str, bound: int | None = None,
            least: int = 50) -> DataFrame:
    """AUC-ROC, average precision and its lift per group; exact under ties.

    Rows are first counted per distinct score, which is what the shuffle carries; a group with very many
    scores is walked in lanes.
    """
    by = list(by)
    y = F.col(label).cast("int")
    s = F.col(score).cast("double")
    known = long.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")) & y.isNotNull())
    cells = known.groupBy(*by, (-s).alias("_s")).agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"))
    lanes = lay_out(cells, by, ["_s"], bound=bound)
    ran = lanes.done(lanes.running(lanes.df, _cp=("sum", F.col("_p")), _cn=("sum", F.col("_n"))))
    pairs = F.col("_n") * (F.col("_cp") - F.col("_p") / 2.0)
    steps = F.col("_p") * F.col("_cp") / (F.col("_cp") + F.col("_cn"))
    g = ran.groupBy(*by).agg(F.sum("_p").alias("_P"), F.sum("_n").alias("_N"), F.sum(pairs).alias("_pairs"),
                             F.sum(steps).alias("_steps"))
    n = F.col("_P") + F.col("_N")
    return g.where((n >= least) & (F.col("_P") > 0) & (F.col("_N") > 0)).select(
        *by, n.alias("n"), (F.col("_P") / n).alias("base_rate"),
        (F.col("_pairs") / (F.col("_P").cast("double") * F.col("_N"))).alias("auc_roc"),
        (F.col("_steps") / F.col("_P")).alias("auc_pr"),
        (F.col("_steps") / F.col("_P") / (F.col("_P") / n)).alias("auc_pr_lift"))


def evaluate(long: DataFrame, by: Sequence[str], y="y", p="p", last: str | None = None, lo: str | None = None,
             hi: str | None = None, least: int = 10) -> DataFrame:
    """Point metrics per group: MAE, RMSE, R2, bias, target deviation, direction, coverage, width."""
    known = long.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    yc, pc = F.col(y).cast("double"), F.col(p).cast("double")
    e = pc - yc
    aggs = [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (1 - F.avg(e * e) / F.nullif(F.var_pop(yc), F.lit(0.0))).alias("r2"), F.avg(e).alias("bias"),
            F.stddev_pop(yc).alias("target_sd")]
    if last:
        dt, dp = yc - F.col(last), pc - F.col(last)
        moved = F.abs(dt) > 1e-9
        same = F.avg(F.when(moved, (F.signum(dt) == F.signum(dp)).cast("double")))
        aggs.append(F.when(F.max(F.abs(dp)) > 1e-9, same).alias("direction"))
    if lo and hi:
        aggs += [F.avg(yc.between(F.col(lo), F.col(hi)).cast("double")).alias("cover80"),
                 F.avg(F.col(hi) - F.col(lo)).alias("width")]
    return known.groupBy(*by).agg(*aggs).where(F.col("n") >= least)


def draw_hashes(draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and offset of every draw, from the md5 of ``seed:draw:a`` and ``seed:draw:b``."""
    take = lambda name: [int(hashlib.md5(f"{seed}:{d}:{name}".encode()).hexdigest()[:8], 16) % PRIME for d in range(draws)]
    return np.maximum(np.array(take("a"), np.int64), 1), np.array(take("b"), np.int64)


def row_hash(keys: Sequence[str]) -> Column:
    """A row's number below ``PRIME``, from the md5 of its keys."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % PRIME


def resampled_mean(rows: DataFrame, by: Sequence[str], value: str, row_keys: Sequence[str], draws: int = 200,
                   seed: int = 42, least: int = 10) -> DataFrame:
    """Mean with a percentile interval from Poisson resampling.

    A row's weight in a draw is the Poisson(1) quantile of (multiplier * row + offset) modulo a prime: independent between
    draws, pairwise independent between rows, and the same for every reading of the row. Each task adds up one vector of
    weighted sums per group, so a row is read once however many draws there are.
    """
    by = list(by)
    times, plus = draw_hashes(draws, seed)
    edges = np.array(POISSON_ONE)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        kinds = None

        def hand_on() -> pa.RecordBatch:
            out = [pa.array([g[i] for g in held], kind) for i, kind in enumerate(kinds)]
            out += [pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1] for h in held.values()], pa.float64())]
            out += [pa.array([h[i].tolist() for h in held.values()], pa.list_(pa.float64())) for i in (2, 3)]
            return pa.RecordBatch.from_arrays(out, [*by, "_n", "_sum", "_sv", "_sw"])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v, x = part.column("_v").to_numpy(), part.column("_x").to_numpy()
                weight = np.searchsorted(edges, (x[:, None] * times + plus) % PRIME / PRIME, side="right").astype(float)
                keys = list(zip(*(part.column(c).to_pylist() for c in by))) if by else [()] * len(v)
                code: dict[tuple, int] = {}
                which = np.array([code.setdefault(k, len(code)) for k in keys])
                for group, i in code.items():
                    mine = np.flatnonzero(which == i)
                    h = held.setdefault(group, [0, 0.0, np.zeros(draws), np.zeros(draws)])
                    h[0] += len(mine)
                    h[1] += float(v[mine].sum())
                    h[2] += v[mine] @ weight[mine]
                    h[3] += weight[mine].sum(axis=0)
                if len(held) >= GROUPS:
                    yield hand_on()
                    held = {}
        if held:
            yield hand_on()

    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), row_hash(row_keys).alias("_x"))
    fields = ", ".join([*(f"`{c}` {t}" for c, t in known.dtypes if c in by), "_n long, _sum double, _sv array<double>, _sw array<double>"])
    per_draw = (known.mapInArrow(add_up, fields).select(*by, "_n", "_sum", F.posexplode(F.arrays_zip("_sv", "_sw")).alias("_draw", "_w"))
                .groupBy(*by, "_draw").agg(F.sum("_w._sv").alias("_sv"), F.sum("_w._sw").alias("_sw"), F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum")))
    g = per_draw.groupBy(*by).agg(
        F.max("_n").alias("n"), (F.max("_sum") / F.max("_n")).alias("mean"),
        F.percentile(F.try_divide("_sv", "_sw"), F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return g.where(F.col("n") >= least).select(*by, "n", "mean", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def paired(rows: DataFrame, by: Sequence[str], err_a: str, err_b: str, row_keys: Sequence[str], draws: int = 200,
           seed: int = 42) -> DataFrame:
    """Mean paired difference of two errors with its interval; at least 30 pairs."""
    d = rows.withColumn("_d", F.col(err_a) - F.col(err_b))
    return resampled_mean(d, by, "_d", row_keys, draws, seed, least=30).withColumnRenamed("mean", "delta")


def ship(learned, baseline, width) -> Column:
    """The learned model ships when its gain exceeds the interval width."""
    return F.when(F.col(baseline) - F.col(learned) > F.col(width), "learned model").otherwise("BASELINE")


def slice_gate(df: DataFrame, axes: Sequence[str], metric: Column, margin: float, label: str, least: int = 30,
               reference: Column | None = None, higher_is_better: bool = False) -> DataFrame:
    """Metric per level of every axis against the overall value, by one pass over grouping sets.

    With a reference metric the compared score is the improvement over the level's own reference.
    """
    axes = [a for a in axes if a in df.columns]
    aggs = [F.count("*").alias("n"), metric.cast("double").alias("value"),
            (reference if reference is not None else F.lit(None)).cast("double").alias("reference"),
            *[F.grouping(a).alias(f"_g_{a}") for a in axes]]
    sets = df.groupingSets([[F.col(a)] for a in axes] + [[]], *[F.col(a) for a in axes]).agg(*aggs)
    v, ref = F.col("value"), F.col("reference")
    score = F.when(ref.isNull(), v).otherwise(v - ref if higher_is_better else ref - v)
    sets = sets.withColumn("score", score)
    level = F.coalesce(*[F.when(F.col(f"_g_{a}") == 0, F.col(a).cast("string")) for a in axes])
    axis = F.coalesce(*[F.when(F.col(f"_g_{a}") == 0, F.lit(a)) for a in axes])
    total = sets.where(axis.isNull()).select(v.alias("overall"), F.col("score").alias("overall_score"))
    rows = attach_row(sets.where(axis.isNotNull() & level.isNotNull() & (F.col("n") >= least) & v.isNotNull())
                      .select(axis.alias("axis"), level.alias("level"), "n", "value", "reference", "score"), total)
    gap = F.col("score") - F.col("overall_score")
    return rows.select(F.lit(label).alias("metric"), "axis", "level", "n", "value", "overall", "reference", "score",
                       "overall_score", (F.col("value") - F.col("overall")).alias("raw_gap"), gap.alias("gap"),
                       (F.abs(gap) <= margin).alias("passes"))


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10, bound: int | None = None, least: int = 50) -> DataFrame:
    """Expected calibration error with quantile bins; repeated edges merge."""
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    edges = quantiles(known, [], "_p", {f"e{i}": i / bins for i in range(1, bins)}, bound)
    inner = F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(1, bins)]))
    binned = attach_row(known, edges.select(inner.alias("_edges"))).withColumn(
        "_bin", F.size(F.filter("_edges", lambda e: e < F.col("_p"))))
    g = binned.groupBy("_bin").agg(F.count("*").alias("_n"), F.avg("_p").alias("_conf"), F.avg("_y").alias("_acc"))
    return g.agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.abs(F.col("_conf") - F.col("_acc"))) / F.sum("_n"))
                 .alias("ece")).where(F.col("n") >= least)


def confusion(y, flag) -> list[Column]:
    hit = F.col(y) == 1 if isinstance(y, str) else y == 1
    return [F.count_if(flag & hit).alias("tp"), F.count_if(flag & ~hit).alias("fp"),
            F.count_if(~flag & hit).alias("fn"), F.count_if(~flag & ~hit).alias("tn")]


def operating_point(df: DataFrame, y: str, p: str, cut: float, bound: int | None = None) -> DataFrame:
    """Sensitivity, specificity, predictive values, number needed to alert, Brier, AUCs, ECE, prevalence."""
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("_all", F.lit(1))
    n = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    d = F.col(p) - F.col(y)
    g = known.agg(*confusion(y, F.col(p) >= cut), F.avg(F.col(y).cast("double")).alias("prevalence"),
                  F.avg(d * d).alias("brier"), F.count("*").alias("n"))
    g = g.select("n", "prevalence", "brier", n("tp", "fn").alias("sensitivity"), n("tn", "fp").alias("specificity"),
                 n("tp", "fp").alias("ppv"), n("tn", "fn").alias("npv"))
    g = g.withColumn("nna", F.when(F.col("ppv") > 0, 1 / F.col("ppv")))
    auc = ranking(known, ["_all"], p, y, bound, least=1).select("auc_roc", "auc_pr")
    return attach_row(attach_row(g, auc), calibration_error(known, y, p, bound=bound, least=1).select("ece"))


def decision_curve(df: DataFrame, y: str, p: str, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Net benefit per threshold probability, against treating all and treating none."""
    thresholds = thresholds or [0.01 + i * (0.60 - 0.01) / 39 for i in range(40)]
    each = df.select(F.col(y).alias("_y"), F.col(p).alias("_p"),
                     F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    t = F.col("threshold")
    g = each.groupBy("threshold").agg(F.count("*").alias("n"), *confusion("_y", F.col("_p") >= t)[:2],
                                      F.avg(F.col("_y").cast("double")).alias("prev"))
    odds = t / (1 - t)
    return g.select("threshold", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"),
                    (F.col("prev") - (1 - F.col("prev")) * odds).alias("nb_treat_all"), F.lit(0.0).alias("nb_treat_none"))


def elicitation(df: DataFrame, y: str, p: str, sessions_per_week: float, options=(3, 5, 10, 15, 20)) -> DataFrame:
    """What reviewing N alerts per true event costs and catches."""
    each = df.select(F.col(y).alias("_y"), F.col(p).alias("_p"),
                     F.explode(F.array(*[F.lit(o) for o in options])).alias("nna"))
    g = each.groupBy("nna").agg(F.count("*").alias("n"), *confusion("_y", F.col("_p") >= 1.0 / F.col("nna")))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return g.select("nna", half_even(1.0 / F.col("nna"), 3).alias("implied_p_t"), share("tp", "fn").alias("sensitivity"),
                    share("tp", "fp").alias("ppv"),
                    ((F.col("tp") + F.col("fp")) / F.col("n") * sessions_per_week).alias("alerts_per_week"))


def rare_event(df: DataFrame, by: Sequence[str], y: str, p: str, cut: str, bound: int | None = None) -> DataFrame:
    """PR-AUC lift, Brier skill, precision, recall, lift and alert rate at a per-group cut."""
    flag = F.col(p) >= F.col(cut)
    d = F.col(p) - F.col(y)
    g = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        *confusion(y, flag), F.avg(F.col(y).cast("double")).alias("_base"), F.avg(d * d).alias("brier"),
        F.avg(flag.cast("double")).alias("alert_rate"))
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    g = g.select(*by, "brier", "alert_rate", precision.alias("precision"),
                 F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"),
                 F.try_divide(precision, F.col("_base")).alias("lift"),
                 (1 - F.col("brier") / F.nullif(F.col("_base") * (1 - F.col("_base")), F.lit(0.0))).alias("brier_skill"))
    return g.join(ranking(df, by, p, y, bound, least=1), list(by))


def subgroup_spread(df: DataFrame, labels: str, axis: str, y: str, p: str, margin: float = 0.15,
                    bound: int | None = None, least: int = 50) -> DataFrame:
    """Spread of PR-AUC between the levels of an axis, per label."""
    per = ranking(df.where(F.col(axis).isNotNull()), [labels, axis], p, y, bound, least)
    return per.groupBy(labels).agg(F.count("*").alias("n_levels"), (F.max("auc_pr") - F.min("auc_pr")).alias("spread")
                                   ).withColumn("passes", F.col("spread") <= margin)


def concentration(df: DataFrame, key: str, error: str, shares=(0.05, 0.10, 0.25, 0.50), bound: int | None = None) -> DataFrame:
    """Share of the summed mean errors held by the worst entities."""
    per = df.where(F.col(error).isNotNull()).groupBy(key).agg(F.avg(error).alias("_e")).withColumn("_all", F.lit(1))
    lanes = lay_out(per.withColumn("_o", -F.col("_e")), ["_all"], ["_o", key], bound=bound)
    ran = lanes.running(lanes.df, _cum=("sum", F.col("_e")))
    total = per.agg(F.count("*").alias("_n"), F.sum("_e").alias("_t"))
    rows = attach_row(lanes.done(ran), total)
    k = lambda q: F.greatest(F.lit(1), half_even(F.lit(q) * F.col("_n")).cast("int"))
    picks = F.filter(F.array(*[F.struct(F.lit(q).alias("top_share"), k(q).alias("n_entities")) for q in shares]),
                     lambda s: s["n_entities"] == F.col("step") + 1)
    return rows.select(F.inline(picks), (F.col("_cum") / F.col("_t")).alias("error_share"))


def chain_board(df: DataFrame, by: Sequence[str], y: str, direct: str, chained: str, rate: str,
                row_keys: Sequence[str], draws: int = 200) -> DataFrame:
    """Brier scores of direct, chained and base-rate probabilities, with the paired difference."""
    sq = lambda c: (F.col(c) - F.col(y)) * (F.col(c) - F.col(y))
    rows = df.where(F.col(y).isNotNull()).withColumn("_d", sq(direct)).withColumn("_c", sq(chained))
    g = rows.groupBy(*by).agg(F.avg("_d").alias("brier_direct"), F.avg("_c").alias("brier_chained"),
                              F.avg(sq(rate)).alias("brier_rate"))
    p = paired(rows, by, "_c", "_d", row_keys, draws)
    return g.join(p, list(by)).withColumn("chained_wins", F.col("hi") < 0)
