"""Sessionising a live reading stream: the batch semantics, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.expr import half_even, seconds_between
from seriesloom.operators.sessions import shifted_day


def stream_sessions(readings: DataFrame, key="patient_id", ts="ts", seq="seq", gap="6 hours", late="12 hours",
                    sbp="sbp", dbp="dbp", flow="uf", start_hour: int = 8) -> DataFrame:
    """One row per closed session. A gap of exactly the limit stays inside the session, as in batch.

    ``ts`` must be a timestamp. Works on a static frame too, where the watermark has no effect.
    """
    at = F.struct(ts, seq)
    s = (readings.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap).alias("_w"))
         .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.min_by(sbp, at).alias("sbp"),
              F.min_by(dbp, at).alias("dbp"), F.max_by(sbp, at).alias("sbp_post"), F.min(sbp).alias("sbp_min"),
              F.max(flow).alias("uf_total"), F.count("*").alias("n_meas")))
    return s.drop("_w").select(
        "*", half_even(seconds_between("session_end", "session_start") / 3600.0, 2).alias("session_hours"),
        shifted_day("session_start", start_hour).alias("day"))
