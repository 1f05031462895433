"""Reading stream -> sessions: admission, gap sessionising, reduction, same-day collapse, record joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions.expr import half_even, seconds_between
from seriesloom.functions.lanes import attach_row, lay_out
from seriesloom.functions.skew import attach


def admissible(sbp="sbp", dbp="dbp", sbp_range=(60, 260), dbp_range=(30, 160), min_diff=10) -> Column:
    """Inclusive ranges on both values and a floor on their difference."""
    return (F.col(sbp).between(*sbp_range) & F.col(dbp).between(*dbp_range)
            & (F.col(sbp) - F.col(dbp) >= min_diff))


def shifted_day(ts, start_hour: int = 8) -> Column:
    """The day a timestamp belongs to when days start at ``start_hour``."""
    return F.to_date(F.col(ts) - F.expr(f"INTERVAL {int(start_hour)} HOURS"))


def number_runs(readings: DataFrame, key="patient_id", ts="ts", seq="seq", gap_hours: float = 6.0,
                bound: int | None = None) -> DataFrame:
    """Add ``run``: a new run starts at the first row and after every gap longer than ``gap_hours``."""
    lanes = lay_out(readings, [key], [ts, seq], reach=1, bound=bound)
    gap = seconds_between(ts, F.lag(ts).over(lanes.window))
    marked = lanes.df.withColumn("_new", F.when(gap.isNull() | (gap > gap_hours * 3600.0), 1).otherwise(0))
    return lanes.done(lanes.running(marked, run=("sum", F.col("_new")))).drop("_new", "step")


def reduce_runs(runs: DataFrame, key="patient_id", ts="ts", seq="seq", sbp="sbp", dbp="dbp", flow="uf",
                start_hour: int = 8) -> DataFrame:
    """One row per run: first and last vitals, minimum, peak flow, count, duration, shifted day."""
    at = F.struct(ts, seq)
    agg = runs.groupBy(key, "run").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
        F.min_by(sbp, at).alias("sbp"), F.min_by(dbp, at).alias("dbp"),
        F.max_by(sbp, at).alias("sbp_post"), F.min(sbp).alias("sbp_min"),
        F.max(flow).alias("uf_total"), F.count("*").alias("n_meas"))
    return agg.select(
        "*",
        half_even(seconds_between("session_end", "session_start") / 3600.0, 2).alias("session_hours"),
        shifted_day("session_start", start_hour).alias("day"),
        (F.to_date("session_end") != F.to_date("session_start")).alias("crosses_midnight"))


def collapse_days(sessions: DataFrame, key="patient_id") -> DataFrame:
    """One row per (key, day): first vitals, last post value, minimum, summed flow, counts and hours."""
    at = F.struct("session_start", "run")
    out = sessions.groupBy(key, "day").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.min_by("sbp", at).alias("sbp"), F.min_by("dbp", at).alias("dbp"),
        F.max_by("sbp_post", at).alias("sbp_post"), F.min("sbp_min").alias("sbp_min"),
        F.sum("uf_total").alias("_uf"), F.sum("n_meas").alias("n_meas"),
        F.sum("session_hours").alias("session_hours"), F.count("*").alias("n_runs"))
    flow = F.when(F.col("n_runs") > 1, F.coalesce("_uf", F.lit(0.0))).otherwise(F.col("_uf"))
    return (out.withColumn("uf_total", flow).drop("_uf")
            .withColumn("sbp_drop", F.col("sbp") - F.col("sbp_min")))


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Keep the first row per key tuple by ``order``; partial aggregation keeps hot keys cheap."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*")


def attach_records(sessions: DataFrame, records: DataFrame, key="patient_id") -> DataFrame:
    """Left join of one record per (key, day); a session without record keeps null measures."""
    out = sessions.join(records.select(key, "day", "weightstart", "weightend", "dryweight", "temperature"),
                        [key, "day"], "left")
    return out.select("*", F.col("weightstart").alias("weight"),
                      (F.col("weightstart") - F.col("dryweight")).alias("idwg"),
                      F.when(F.col("weightstart").isNotNull(), "d1").otherwise("vip_only")
                      .alias("session_source"))


def attach_static(sessions: DataFrame, static: DataFrame, key="patient_id", bound: int | None = None) -> DataFrame:
    """Left join of one static row per key; ``bound`` limits the sessions of a key."""
    return attach(sessions, first_per_key(static, [key], ["gender", "age", "DM"]), key, bound=bound)


def with_age(static: DataFrame, reference_year: int, birthday="birthday", first="first_dialysis") -> DataFrame:
    """Age from the birth year; ``YYYY-MM`` strings become timestamps, bad ones null."""
    return static.select(
        "*", (F.lit(reference_year) - F.col(birthday)).cast("double").alias("age"),
        F.try_to_timestamp(F.col(first), F.lit("yyyy-MM")).alias("first_dialysis_ts"))


def key_sets(sessions: DataFrame, records: DataFrame, key="patient_id", bound: int | None = None) -> DataFrame:
    """Distinct (key, day) pairs of both sides with presence flags and the other side's span."""
    s = sessions.select(key, "day").distinct().withColumn("in_sessions", F.lit(True))
    r = records.select(key, "day").distinct().withColumn("in_records", F.lit(True))
    pairs = s.join(r, [key, "day"], "full_outer").na.fill(False, ["in_sessions", "in_records"])
    span_s = sessions.groupBy(key).agg(F.min("day").alias("s_lo"), F.max("day").alias("s_hi"))
    span_r = records.groupBy(key).agg(F.min("day").alias("r_lo"), F.max("day").alias("r_hi"))
    placed = attach(attach(pairs, span_s, key, bound=bound), span_r, key, bound=bound)
    inside_r = F.coalesce(F.col("day").between(F.col("r_lo"), F.col("r_hi")), F.lit(False))
    inside_s = F.coalesce(F.col("day").between(F.col("s_lo"), F.col("s_hi")), F.lit(False))
    return placed.select(key, "day", "in_sessions", "in_records",
                         F.when(~F.col("in_records"), inside_r).alias("inside_record_span"),
                         F.when(~F.col("in_sessions"), inside_s).alias("inside_session_span"))


def decompose(pairs: DataFrame, counters: DataFrame) -> DataFrame:
    """Attribute the difference between sessions and records to named causes.

    ``counters`` is one row: published, derived, duplicate_records, second_runs, crossings,
    calendar_sessions, undated.
    """
    s, r = F.col("in_sessions"), F.col("in_records")
    sets = pairs.agg(
        F.count_if(s & r).alias("matched"),
        F.count_if(s & ~r & F.col("inside_record_span")).alias("left_in"),
        F.count_if(s & ~r & ~F.col("inside_record_span")).alias("left_out"),
        F.count_if(r & ~s & F.col("inside_session_span")).alias("right_in"),
        F.count_if(r & ~s & ~F.col("inside_session_span")).alias("right_out"))
    one = attach_row(sets, counters).withColumn("delta", F.col("derived") - F.col("published"))
    base = F.greatest(F.col("delta"), F.lit(1))
    part = lambda c: half_even(F.col(c) / base, 4)
    lines = [
        ("published sessions", "published", None), ("derived sessions", "derived", None),
        ("delta", "delta", F.lit(1.0)), ("matched a record", "matched", None),
        ("no record, inside the record span", "left_in", part("left_in")),
        ("no record, outside the record span", "left_out", part("left_out")),
        ("second run on the same day", "second_runs", None),
        ("duplicate records", "duplicate_records", None),
        ("record without reading, inside the session span", "right_in", None),
        ("record without reading, outside the session span", "right_out", None),
        ("undated records", "undated", None), ("sessions crossing midnight", "crossings", None),
        ("sessions under calendar keying", "calendar_sessions", None)]
    rows = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(n).alias("component"),
                              F.col(c).cast("long").alias("n"),
                              (p if p is not None else F.lit(None)).cast("double").alias("share_of_delta"))
                     for i, (n, c, p) in enumerate(lines)])
    return one.select(F.inline(rows))


def reconcile(counters: DataFrame, quantities) -> DataFrame:
    """Published against derived counts: ``quantities`` is (label, published or None, column)."""
    rows = F.array(*[F.struct(F.lit(label).alias("quantity"), F.lit(pub).cast("double").alias("published"),
                              F.col(c).cast("double").alias("derived")) for label, pub, c in quantities])
    return (counters.select(F.inline(rows))
            .withColumn("ratio", half_even(F.try_divide(F.col("derived"), F.col("published")), 3)))
