"""Series windows that survive a series holding a large share of all rows.

A plain ``Window.partitionBy(key)`` puts one series into one task. ``lay_out`` keeps that plan (one
shuffle on the key) while every series is short, and cuts only the long ones into *lanes*: runs of at
most ``LANE_ROWS`` consecutive rows, each carrying an echo of its neighbours' border rows. Bounded
frames (lag, lead, rolling) read the echo; running aggregates add what earlier lanes carried over.
No row is dropped: echo rows exist only while windows are evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.lineage import pin

LANE_ROWS = 1_000_000        # rows one task sorts for one series
BROADCAST_KEYS = 100_000     # a key list up to this size may be broadcast

_LANE, _ECHO, _LONG, _PIECE = "_lane", "_echo", "_long", "_piece"
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_LOCAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def small(df: DataFrame, rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast hint only when the counted size allows it."""
    return F.broadcast(df) if rows <= limit else df


class Lanes:
    """A table laid out as ordered series. ``df`` carries ``step`` (0-based row number).

    When series were cut, running and whole-series aggregates of the long ones need what other lanes
    hold. That summary has one row per lane; it is computed from the long series alone and pinned, so
    plans grow by one small broadcast join per aggregate and the short series are not read again.
    """

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str], split: bool, longest: int):
        self.df, self.key, self.order, self.split = df, list(key), list(order), split
        self.longest = longest          # an upper bound of the rows per series
        self.part = self.key + ([_LONG, _LANE] if split else [])
        self.window = Window.partitionBy(*self.part).orderBy(*self.order)

    def rows(self, first: int, last: int):
        """A bounded ROWS frame; it must stay inside the reach given to ``lay_out``."""
        return self.window.rowsBetween(first, last)

    def own(self, value: Column) -> Column:
        """The value on the lane's own rows, null on echo rows."""
        return F.when(~F.col(_ECHO), value) if self.split else value

    def summary(self, df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
        """Aggregates of the long series' own rows, pinned; one row per lane or per long series."""
        return pin(df.where(F.col(_LONG) & ~F.col(_ECHO)).groupBy(*by).agg(*aggs))

    def attach(self, df: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.join(small(summary, summary.count()), list(by), "left")

    def before(self):
        """All earlier lanes of a series, for windows over a lane summary."""
        return Window.partitionBy(*self.key).orderBy(_LANE).rowsBetween(Window.unboundedPreceding, -1)

    def running(self, df: DataFrame, last: int = 0, **specs: tuple[str, Column]) -> DataFrame:
        """Add running aggregates from the start of the series up to row ``last`` (0 or -1).

        Each spec is ``name=("sum" | "count" | "min" | "max", column expression)``.
        """
        frame = self.window.rowsBetween(Window.unboundedPreceding, last)
        local = {n: _LOCAL[a](self.own(c)).over(frame) for n, (a, c) in specs.items()}
        if not self.split:
            return df.select("*", *[c.alias(n) for n, c in local.items()])
        totals = self.summary(df, self.part, *[_LOCAL[a](c).alias(f"_t_{n}") for n, (a, c) in specs.items()])
        carry = totals.select(*self.part, *[_MERGE[a](f"_t_{n}").over(self.before()).alias(f"_c_{n}")
                                            for n, (a, _) in specs.items()])
        out = self.attach(df.select("*", *[c.alias(f"_l_{n}") for n, c in local.items()]), carry, self.part)
        made = []
        for n, (a, _) in specs.items():
            here, past = F.col(f"_l_{n}"), F.col(f"_c_{n}")
            if a in ("sum", "count"):
                v = F.when(here.isNull() | past.isNull(), F.coalesce(here, past)).otherwise(here + past)
            else:
                v = (F.least if a == "min" else F.greatest)(here, past)
            made.append(v.alias(n))
        return out.select(*df.columns, *made)

    def moments(self, df: DataFrame, prefix: str, value: Column, last: int = -1) -> DataFrame:
        """Running count, mean and sample deviation as ``<prefix>_n``, ``_mean`` and ``_std``."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, last)
        v = self.own(value.cast("double"))
        n, m, s = F.count(v).over(frame), F.avg(v).over(frame), F.stddev_samp(v).over(frame)
        if not self.split:
            return df.select("*", n.alias(f"{prefix}_n"), m.alias(f"{prefix}_mean"), s.alias(f"{prefix}_std"))
        lane = self.summary(df, self.part, F.count(value).alias("_n"), F.avg(value).alias("_m"),
                            F.var_pop(value.cast("double")).alias("_v"))
        past = self.before()
        carry = (lane.select(*self.part,
                             F.sum("_n").over(past).alias("_pn"),
                             F.sum(F.col("_n") * F.col("_m")).over(past).alias("_ps"),
                             F.sum(F.col("_n") * F.col("_v")).over(past).alias("_pv"),
                             F.sum(F.col("_n") * F.col("_m") * F.col("_m")).over(past).alias("_pq"))
                 .withColumn("_pm", F.try_divide("_ps", "_pn"))
                 .withColumn("_p2", F.col("_pv") + F.col("_pq") - F.col("_ps") * F.col("_pm"))
                 .select(*self.part, "_pn", "_pm", "_p2"))
        o = self.attach(df.select("*", n.alias("_ln"), m.alias("_lm"), F.var_pop(v).over(frame).alias("_lv")),
                        carry, self.part)
        pn, ln = F.coalesce("_pn", F.lit(0)), F.col("_ln")
        pm, lm = F.coalesce("_pm", F.lit(0.0)), F.coalesce("_lm", F.lit(0.0))
        total = pn + ln
        m2 = (F.coalesce("_p2", F.lit(0.0)) + ln * F.coalesce("_lv", F.lit(0.0))
              + F.coalesce(F.try_divide((lm - pm) * (lm - pm) * pn * ln, total), F.lit(0.0)))
        return o.select(*df.columns, total.alias(f"{prefix}_n"),
                        F.try_divide(pn * pm + ln * lm, total).alias(f"{prefix}_mean"),
                        F.when(total > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (total - 1)))
                        .alias(f"{prefix}_std"))

    def whole(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """Add whole-series aggregates to every row."""
        w = Window.partitionBy(*self.part)
        if not self.split:
            return df.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])
        per = self.summary(df, self.key, *[c.alias(f"_w_{n}") for n, c in aggs.items()])
        out = self.attach(df.select("*", *[c.over(w).alias(f"_l_{n}") for n, c in aggs.items()]), per, self.key)
        return out.select(*df.columns, *[F.when(F.col(_LONG), F.col(f"_w_{n}")).otherwise(F.col(f"_l_{n}")).alias(n)
                                         for n in aggs])

    def done(self, df: DataFrame) -> DataFrame:
        """Drop echo rows and helper columns."""
        return df.where(~F.col(_ECHO)).drop(_LANE, _ECHO, _LONG) if self.split else df


def lay_out(df: DataFrame, key: Sequence[str], order: Sequence[str], reach: int = 0,
            bound: int | None = None, lane_rows: int | None = None) -> Lanes:
    """Lay ``df`` out by ``key`` in ``order`` (a total order inside a series).

    ``reach`` is the widest bounded frame used later. ``bound`` is a known upper bound of the rows
    per series; without it one narrow counting job over the key columns decides.
    """
    lane_rows = lane_rows or LANE_ROWS
    key, order = list(key), list(order)
    if reach >= lane_rows:
        raise ValueError("a lane must be longer than the frames that read it")
    by_key = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumn("step", (F.row_number().over(by_key) - 1).cast("long"))
    if bound is not None and bound <= lane_rows:
        return Lanes(numbered, key, order, False, bound)
    sizes = df.groupBy(*key).count()
    over = F.col("count") > lane_rows
    n_long, n_rows, longest = sizes.agg(F.count_if(over), F.sum(F.when(over, F.col("count"))),
                                        F.max("count")).first()
    if not n_long:
        return Lanes(numbered, key, order, False, longest or 0)
    sizes = sizes.where(over)

    keys = small(sizes.select(*key), n_long)
    short = (df.join(keys, key, "left_anti")
             .withColumn("step", (F.row_number().over(by_key) - 1).cast("long")))
    # A range shuffle spreads one key over many partitions; pinning it fixes the piece numbers.
    pieces = max(2, math.ceil(n_rows / lane_rows))
    placed = pin(df.join(keys, key, "left_semi").repartitionByRange(pieces, *key, *order)
                 .withColumn(_PIECE, F.spark_partition_id()))
    ahead = Window.partitionBy(*key).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy(*key, _PIECE).agg(F.count("*").alias("_n"))
              .select(*key, _PIECE, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(*key, _PIECE).orderBy(*order)
    long = (placed.join(starts, [*key, _PIECE])
            .withColumn("step", (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
            .drop(_PIECE, "_start"))
    home = F.floor(F.col("step") / lane_rows)
    offset = F.col("step") % lane_rows
    lanes = F.array_compact(F.array(
        home,
        F.when(offset >= lane_rows - reach, home + 1),
        F.when((offset < reach) & (home > 0), home - 1)))
    spread = pin(long.withColumn("_home", home).withColumn(_LANE, F.explode(lanes))
                 .withColumn(_ECHO, F.col(_LANE) != F.col("_home")).drop("_home"))
    both = (short.withColumn(_LANE, F.lit(0).cast("long")).withColumn(_ECHO, F.lit(False))
            .withColumn(_LONG, F.lit(False)).unionByName(spread.withColumn(_LONG, F.lit(True))))
    return Lanes(both, key, order, True, longest)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (an aggregate without keys) to every row."""
    return (df.withColumn("_one", F.lit(0))
            .join(F.broadcast(row.withColumn("_one", F.lit(0))), "_one").drop("_one"))
