"""The base rule cascade over a live stream, in event time.

Rows wait in a list state until the watermark has passed them, so rows that arrive out of order are judged in order. An
event-time timer stands at a key's earliest waiting row, or, when none waits, where the key counts as idle and its state
is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriesloom.config import STALE_DAYS
from seriesloom.operators.rules import base_cases, decide, gate

DAY_US = 86_400_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "us long, seq long, sbp double, dbp double, n_meas long, age double"
LAST = "step long, us long, emergency boolean"
READY = ["step", "days_since_last", "previous_emergency"]
PREPARED = f"series_id long, {WAITING}, step long, days_since_last double, previous_emergency boolean"


def in_order(rows: pd.DataFrame, last: tuple[int, int, bool] | None, idle_us: int) -> tuple[pd.DataFrame, tuple[int, int, bool]]:
    """Sorted rows with step, gap and the previous row's emergency, after the row ``last``; and the new last row.

    A gap beyond ``idle_us`` starts the series anew, whether or not the old state had been dropped by then."""
    us = rows["us"].to_numpy()
    step, before, urgent = last or (-1, us[0] - idle_us - 1, False)
    gap_us = np.diff(us, prepend=before)
    new = gap_us > idle_us
    at = np.arange(len(us))
    since = np.maximum.accumulate(np.where(new, at, -1))                   # where the row's series began, -1: before these rows
    steps = np.where(since >= 0, at - since, at + step + 1)
    gap = np.clip(np.where(new, 2.0, gap_us // DAY_US), 1.0, 30.0)
    emergency = ((rows["sbp"].to_numpy() >= 180) | (rows["dbp"].to_numpy() >= 120)) & (gap <= STALE_DAYS)
    previous = np.append(urgent, emergency[:-1]) & ~new
    return rows.assign(step=steps, days_since_last=gap, previous_emergency=previous), (int(steps[-1]), int(us[-1]), bool(emergency[-1]))


class InOrder(StatefulProcessor):
    """Releases a key's rows in event order as the watermark passes them."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", LAST)
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, us: int) -> None:
        """One timer a key: the first whole millisecond at or after ``us``."""
        ms, set_to = -(-us // 1000), self.timer.get()[0] if self.timer.exists() else None
        if ms != set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, nothing_waits = None, not self.waiting.exists()
        for batch in rows:
            kept = batch[[f.split()[0] for f in WAITING.split(", ")]]
            self.waiting.appendList(list(kept.itertuples(index=False, name=None)))
            first = int(kept["us"].min()) if first is None else min(first, int(kept["us"].min()))
        if first is not None and (nothing_waits or not self.timer.exists() or -(-first // 1000) < self.timer.get()[0]):
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        rows = pd.DataFrame(list(self.waiting.get()), columns=[f.split()[0] for f in WAITING.split(", ")])
        out = rows[rows["us"] <= passed].sort_values(["us", "seq"], ignore_index=True)
        later = rows[rows["us"] > passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        if len(out):
            out, last = in_order(out, last, self.idle_us)
            self.last.update(last)
            self.waiting.clear()
            if len(later):
                self.waiting.put(list(later.itertuples(index=False, name=None)))
        if len(later):
            self._wake(int(later["us"].min()))
        elif last is not None and last[1] + self.idle_us < passed:
            self.last.clear()
        elif last is not None:
            self._wake(last[1] + self.idle_us + 1)
        return iter([out.assign(series_id=key[0])[[f.split()[0] for f in PREPARED.split(", ")]]] if len(out) else [])


def stream_alerts(readings: DataFrame, late: str = "12 hours", idle_days: float = 90) -> DataFrame:
    """Readings (series_id, ts, seq, sbp, dbp, n_meas, age) to verdicts, in append mode and event order.

    Rows up to ``late`` behind the newest are put in order by (ts, seq); later ones are dropped. A verdict appears when the
    watermark has passed its row. A key that is silent for more than ``idle_days`` starts anew, and its state is dropped
    once the watermark says so; until then the state is its last row and the rows that wait. Null readings never fire. The
    session must use the RocksDB state store (``STORE``); the cascade itself is the CASE of the batch operator.
    """
    rows = readings.select("series_id", "ts", F.unix_micros("ts").alias("us"), "seq", "sbp", "dbp", "n_meas", "age").withWatermark("ts", late)
    ready = rows.groupBy("series_id").transformWithStateInPandas(InOrder(int(idle_days * DAY_US)), PREPARED, "append", "eventTime")
    return judge(ready.select("series_id", F.timestamp_micros("us").alias("ts"), "seq", "sbp", "dbp", "n_meas", "age", *READY))


def judge(prepared: DataFrame) -> DataFrame:
    """The base cascade where the previous emergency is a column instead of a lag."""
    d = prepared.withColumn("_gate", gate(prepared))
    emergency = ((F.col("sbp") >= 180) | (F.col("dbp") >= 120)) & (F.col("_gate") != "HISTORICAL_ENTRY")
    return decide(d, prepared.columns, base_cases(emergency, F.col("previous_emergency")))
