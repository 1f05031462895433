"""Lags, rolling statistics and smoothing of many columns in one pass over the rows of laid-out series.

For callers that read most features: a window function copies the whole row once per window operator and walks every frame
anew per column, which for some hundred columns is most of a query's time. Here the rows of a partition, in the order of
their series, go by in batches; a frame is as many shifted vectors as it has rows, and ``REACH`` rows are kept between
batches. The sums and moments are those of Spark's aggregates, added up in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from seriesloom.functions.lanes import Lanes

_AT, _STEP = "_at", "_step"
REACH = 31


class Dense:
    """What is wanted of which input. Every method returns the columns by name; ``run`` makes them."""

    def __init__(self):
        self.inputs: list[Column] = []
        self.known: dict[str, int] = {}
        self.lags: list[tuple[str, int, int]] = []                       # name, input, rows back
        self.means: list[tuple[str, int, int, int]] = []                 # name, input, rows, least known
        self.levels: list[tuple[str, int, int]] = []                     # prefix, input, rows
        self.smooth: list[tuple[str, int, float]] = []                   # name, input, alpha

    def input(self, name: str, value: Column) -> int:
        if name not in self.known:
            self.known[name] = len(self.inputs)
            self.inputs.append(value.cast("double").alias(f"_in{len(self.inputs)}"))
        return self.known[name]

    def lag(self, source: str, value: Column, k: int, name: str) -> Column:
        self.lags.append((name, self.input(source, value), k))
        return F.col(name)

    def mean(self, source: str, value: Column, w: int, least: int, name: str) -> Column:
        self.means.append((name, self.input(source, value), w, least))
        return F.col(name)

    def level(self, source: str, value: Column, lags: Sequence[int], windows: Sequence[int]) -> list[Column]:
        """Lags, mean, deviation, extremes, range and slope per window, and the first difference."""
        at = self.input(source, value)
        out = [self.lag(source, value, k, f"{source}_lag{k}") for k in lags]
        for w in windows:
            self.levels.append((source, at, w))
            out += [F.col(f"{source}_{n}{w}") for n in LEVELS]
        return out

    def ewm(self, source: str, value: Column, alpha: float, name: str) -> Column:
        self.smooth.append((name, self.input(source, value), alpha))
        return F.col(name)

    def names(self) -> list[str]:
        return [*(n for n, *_ in self.lags), *(n for n, *_ in self.means), *(f"{s}_{n}{w}" for s, _, w in self.levels for n in LEVELS),
                *(n for n, *_ in self.smooth)]

    def run(self, lanes: Lanes, df: DataFrame) -> DataFrame:
        """``df`` and the wanted columns; smoothing takes uncut series."""
        if self.smooth and lanes.split:
            raise ValueError("smoothing runs on from lane to lane")
        reach = max([k for *_, k in self.lags] + [w for _, _, w, _ in self.means] + [w for *_, w in self.levels] + [1])
        if reach > REACH:
            raise ValueError(f"a frame of {reach} rows")
        kept, made = df.columns, self.names()
        rows = df.select("*", *self.inputs, F.col("step").cast("double").alias(_STEP), F.row_number().over(lanes.window).alias(_AT)).sortWithinPartitions(*lanes.part, *lanes.order)
        shape = StructType([*df.schema.fields])
        for n in made:
            shape = shape.add(n, DoubleType())
        return rows.mapInArrow(_walk(kept, made, len(self.inputs), self.lags, self.means, self.levels, self.smooth), shape)


LEVELS = ("mean", "std", "min", "max", "range", "slope")


def _walk(kept, made, n_inputs, lags, means, levels, smooth):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = np.zeros((n_inputs, REACH))                               # the rows before, and whether they are known
        past_known = np.zeros((n_inputs, REACH), bool)
        before, at0 = -1, 0                                              # place of the row before in its series, rows gone by
        state = {name: (math.nan, -1) for name, *_ in smooth}            # level, row of its last value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = batch.column(_AT).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            if not ((place == 0) | (place == np.concatenate([[before], place[:-1]]) + 1)).all():
                raise RuntimeError("rows of a series do not follow each other")
            before = int(place[-1])
            step = batch.column(_STEP).to_numpy(zero_copy_only=False)
            columns = [batch.column(f"_in{i}") for i in range(n_inputs)]
            known = np.concatenate([past_known, [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]], 1)
            x = np.concatenate([past, [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]], 1)
            past, past_known = x[:, n:].copy(), known[:, n:].copy()

            def back(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
                """Values of ``j`` rows ago, and whether there is one."""
                return x[i, REACH - j:REACH - j + n], known[i, REACH - j:REACH - j + n] & (place >= j)

            out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for name, i, k in lags:
                out[name] = back(i, k)
            for name, i, w, least in means:
                count, total = np.zeros(n), np.zeros(n)
                for j in range(w, 0, -1):
                    v, ok = back(i, j)
                    count += ok
                    total += np.where(ok, v, 0.0)
                out[name] = total / np.maximum(count, 1), count >= least
            for s, i, w in levels:
                for kind, found in zip(LEVELS, _level(back, i, w, step)):
                    out[f"{s}_{kind}{w}"] = found
            for name, i, alpha in smooth:
                u, ok = back(i, 1)
                out[name], state[name] = _smoothed(u, ok, place, alpha, at0, *state[name])
            at0 += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(out[c][0], mask=~out[c][1]) for c in made)], [*kept, *made])

    return walk


def _level(back, i: int, w: int, step: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Mean, deviation, extremes, range and slope of the ``w`` rows before, as Spark's aggregates update them."""
    n = len(step)
    count, total, mean, m2, cross, x_mean, x_m2 = (np.zeros(n) for _ in range(7))
    low, high = np.full(n, np.nan), np.full(n, -np.inf)
    for at, j in enumerate(range(w, 0, -1), 1):
        v, ok = back(i, j)
        count += ok
        total += np.where(ok, v, 0.0)
        off = v - mean
        part = off / np.maximum(count, 1)
        mean = np.where(ok, mean + part, mean)
        m2 += np.where(ok, off * (off - part), 0.0)
        low = np.fmin(low, np.where(ok, v, np.nan))
        high = np.maximum(high, np.where(ok, v, -np.inf))
        x_off = step - j - x_mean                                        # a slope needs every row, and rows are one step apart
        x_part = x_off / at
        x_mean = x_mean + x_part
        x_m2 += x_off * (x_off - x_part)
        cross += np.where(ok, x_off * (v - mean), 0.0)
    enough = count >= max(2, w // 3)
    yield total / np.maximum(count, 1), enough
    yield np.sqrt(m2 / np.maximum(count - 1, 1)), enough & (count > 1)
    yield low, enough
    yield high, enough
    yield high - low, enough
    sloped = (count == w) & (x_m2 > 0)
    yield cross / np.where(sloped, x_m2, 1.0), sloped


def _smoothed(u: np.ndarray, ok: np.ndarray, place: np.ndarray, alpha: float, at0: int, level: float, last: int):
    """Exponential smoothing of ``u``: the level and whether there is one, and (level, row of the last value) to go on from.

    A missing value leaves the level as it is but ages it.
    """
    row = np.arange(at0, at0 + len(u))
    seen = np.maximum.accumulate(np.where(ok, row, -1))
    earlier = np.maximum(np.concatenate([[-1], seen[:-1]]), last)
    fresh = earlier < row - place                                        # no value in this series yet
    grown = alpha * np.exp(np.minimum((row - earlier) * -math.log(1 - alpha), 500.0))
    keep = np.where(ok, np.where(fresh, 0.0, 1 / (1 + grown)), np.where(fresh, 0.0, 1.0))
    add = np.where(ok, np.where(fresh, u, u * (grown / (1 + grown))), np.where(fresh, math.nan, 0.0))
    out = []
    for k, a in zip(keep.tolist(), add.tolist()):
        level = level * k + a if k else a
        out.append(level)
    return (np.array(out), ok | ~fresh), (level, int(max(seen[-1], last)))
