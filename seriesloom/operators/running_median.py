"""Exact running median of the rows before the current one, for series of any length.

Short series use a window aggregate over the growing frame. A long series is cut into chunks of rows.
While a chunk is read, the median moves over at most ``CHUNK_ROWS`` order statistics of all earlier rows,
so each chunk needs only that slice of its past. Where it lies is found on two levels: counts per chunk and range of
values, added up over chunks, give the range; counts per value bucket inside that one range give the bucket.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seriesloom.functions.lanes import Lanes, lay_out
from seriesloom.lineage import pin

SHORT_ROWS = 2_000
CHUNK_ROWS = 20_000
SHARE_CHUNKS = 32       # chunks served by one copy of a value bucket


def walk(pool: list, below: int, seen: int, values: np.ndarray, least: int) -> np.ndarray:
    """Median before each value. ``pool`` is the sorted slice, with ``below`` earlier values under it."""
    out = np.full(len(values), np.nan)
    for i, v in enumerate(values):
        if seen >= max(least, 1):
            at = (seen - 1) / 2 - below
            lo = int(np.floor(at))
            out[i] = pool[lo] if at == lo else (pool[lo] + pool[lo + 1]) / 2
        if v == v:
            bisect.insort(pool, v)
            seen += 1
    return out


def expanding_median(lanes: Lanes, df: DataFrame, value: str, name: str, least: int = 5,
                     short_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Add ``name``: the median of ``value`` over all earlier rows, null below ``least`` values."""
    short_rows, size = short_rows or SHORT_ROWS, chunk_rows or CHUNK_ROWS
    if lanes.longest <= short_rows and not lanes.split:
        frame = lanes.window.rowsBetween(Window.unboundedPreceding, -1)
        v = F.col(value).cast("double")
        return df.select("*", F.when(F.count(v).over(frame) >= least,
                                     F.percentile(v, F.lit(0.5)).over(frame)).alias(name))
    key = lanes.key
    rows = pin(lanes.done(df).select(*key, "step", F.col(value).cast("double").alias("_v"),
                                     F.floor(F.col("step") / size).alias("_chunk")))
    got = _long_medians(rows, key, name, least, size)
    return df.join(got, [*key, "step"], "left")


def locate(values: DataFrame, extent: DataFrame, key, size: int, fan: int) -> DataFrame:
    """(key, _chunk, _lo, _hi, _below, _seen): the buckets that hold the order statistics a chunk can reach in its past.

    ``values`` has (key, _chunk, _vb), ``extent`` one row per series with its last chunk ``_c`` and last bucket ``_b``;
    ``fan`` buckets make a range. Ranges are counted for every chunk; buckets only inside the ranges asked for, where the
    questions are sorted among the counts. With N rows that is (N / size) * (N / size / fan) + N cells, not the square.
    """
    before = Window.unboundedPreceding
    ranged = values.withColumn("_sb", F.floor(F.col("_vb") / fan))
    grid = (extent.select(*key, F.floor(F.col("_b") / fan).alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c"))).alias("_chunk"))
            .select(*key, "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s"))).alias("_sb")))
    past = Window.partitionBy(*key, "_sb").orderBy("_chunk").rowsBetween(before, -1)
    chunk = Window.partitionBy(*key, "_chunk")
    placed = (grid.join(ranged.groupBy(*key, "_chunk", "_sb").agg(F.count("*").alias("_n")), [*key, "_chunk", "_sb"], "left")
              .withColumn("_p", F.coalesce(F.sum("_n").over(past), F.lit(0)))
              .withColumn("_under", F.coalesce(F.sum("_p").over(chunk.orderBy("_sb").rowsBetween(before, -1)), F.lit(0)))
              .withColumn("_seen", F.sum("_p").over(chunk)).where("_seen > 0"))
    lo = F.greatest(F.floor((F.col("_seen") - size) / 2) - 1, F.lit(0))
    hi = F.least(F.ceil((F.col("_seen") + size) / 2) + 1, F.col("_seen") - 1)
    held = lambda under, p: (F.col(under) <= F.col("_rank")) & (F.col("_rank") < F.col(under) + F.col(p))
    asked = (placed.withColumn("_rank", F.explode(F.array(lo, hi))).where(held("_under", "_p"))
             .withColumn("_vb", F.explode(F.sequence(F.col("_sb") * fan, F.col("_sb") * fan + (fan - 1))))
             .select(*key, "_vb", "_chunk", "_rank", "_under", "_seen"))
    cells = ranged.groupBy(*key, "_vb", "_chunk").agg(F.count("*").alias("_n"))
    none = F.lit(None).cast("long")
    both = (asked.withColumn("_n", F.lit(0).cast("long"))
            .unionByName(cells.select(*key, "_vb", "_chunk", none.alias("_rank"), none.alias("_under"), none.alias("_seen"), "_n")))
    # A question stands before the counts of its own chunk: it sees the chunks before.
    sorted_in = Window.partitionBy(*key, "_vb").orderBy("_chunk", F.col("_rank").isNull()).rowsBetween(before, 0)
    inside = Window.partitionBy(*key, "_chunk", "_rank").orderBy("_vb").rowsBetween(before, -1)
    found = (both.withColumn("_p", F.sum("_n").over(sorted_in)).where(F.col("_rank").isNotNull()).distinct()
             .withColumn("_low", F.col("_under") + F.coalesce(F.sum("_p").over(inside), F.lit(0))).where(held("_low", "_p")))
    return found.groupBy(*key, "_chunk").agg(F.min("_vb").alias("_lo"), F.max("_vb").alias("_hi"), F.min("_low").alias("_below"),
                                             F.max("_seen").alias("_seen"))


def _long_medians(rows: DataFrame, key, name: str, least: int, size: int) -> DataFrame:
    ranked = lay_out(rows.where(F.col("_v").isNotNull()).withColumnRenamed("step", "_at"), key, ["_v", "_at"])
    values = pin(ranked.done(ranked.df).select(*key, "_chunk", "_v", F.floor(F.col("step") / size).alias("_vb")))
    extent = rows.groupBy(*key).agg(F.max("_chunk").alias("_c")).join(values.groupBy(*key).agg(F.max("_vb").alias("_b")), key)
    fan = max(2, math.isqrt(ranked.longest // size) + 1)
    found = pin(locate(values, extent, key, size, fan))
    needed = found.select(*key, F.col("_chunk").alias("_to"), F.explode(F.sequence("_lo", "_hi")).alias("_vb"), "_below", "_seen")
    # The bucket around the median serves nearly every chunk: copy it, so no task serves them all.
    copies = needed.groupBy(*key, "_vb").agg(F.ceil(F.count("*") / SHARE_CHUNKS).alias("_copies"))
    spread = (values.join(copies, [*key, "_vb"])
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies"))
    asked = (needed.join(copies, [*key, "_vb"])
             .withColumn("_copy", F.pmod(F.xxhash64("_to"), F.col("_copies"))).drop("_copies"))
    slices = (asked.join(spread, [*key, "_vb", "_copy"]).where(F.col("_chunk") < F.col("_to"))
              .select(*[F.col(k).alias(k) for k in key], F.col("_to").alias("_chunk"), F.col("_v").alias("_v"),
                      "_below", "_seen"))
    fields = [f for f in rows.schema.fields if f.name in key]
    schema = T.StructType([*fields, T.StructField("step", T.LongType()), T.StructField(name, T.DoubleType())])

    def fill(chunk: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        chunk = chunk.sort_values("step")
        known = len(past) > 0
        got = walk(sorted(past["_v"]), int(past["_below"].iloc[0]) if known else 0,
                   int(past["_seen"].iloc[0]) if known else 0, chunk["_v"].to_numpy(float), least)
        out = chunk[[*key, "step"]].copy()
        out[name] = pd.Series(got, index=out.index).astype(object).where(~np.isnan(got), None)
        return out

    return (rows.groupBy(*key, "_chunk").cogroup(slices.groupBy(*key, "_chunk"))
            .applyInPandas(fill, schema))
