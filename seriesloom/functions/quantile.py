"""Exact interpolated quantiles, per group or over a whole table.

``percentile`` keeps the distinct values of a group in one task. That is the fastest plan for groups
of bounded size; larger groups are answered by counting distinct values and selecting ranks over lanes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.lanes import lay_out

GROUP_ROWS = 2_000_000     # largest group one task may hold for `percentile`
BINS = 256                 # counts per column, group and pass of `column_medians`
_ALL = "_all"


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
              bound: int | None = None, group_rows: int | None = None) -> DataFrame:
    """One row per group: ``by`` columns, then one column per entry of ``probs``."""
    group_rows = group_rows or GROUP_ROWS
    by = list(by)
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    if bound is None:
        bound = largest_group(known, by)
    if bound <= group_rows:
        # One call for all probabilities: the distinct values of a group are kept and sorted once.
        every = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q")
        got = known.groupBy(*by).agg(every) if by else known.agg(every)
        return got.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])

    keys = by or [_ALL]
    if not by:
        known = known.withColumn(_ALL, F.lit(0))
    counted = known.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    lanes = lay_out(counted, keys, [value], lane_rows=group_rows)
    summed = lanes.whole(lanes.running(lanes.df, _hi=("sum", F.col("_n"))), _total=F.sum("_n"))
    joined = lanes.done(summed).withColumn("_lo", F.col("_hi") - F.col("_n"))
    picks = []
    for n, p in probs.items():
        rank = F.floor(F.lit(float(p)) * (F.col("_total") - 1))
        for side, r in (("a", rank), ("b", F.least(rank + 1, F.col("_total") - 1))):
            picks.append(F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), F.col(value)))
                         .alias(f"_{side}_{n}"))
    got = joined.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for n, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        frac = at - F.floor(at)
        out.append((F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * frac).alias(n))
    return got.select(*by, *out)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as long integers of the same order."""
    bits = (x + 0.0).view(np.int64)                                         # -0.0 becomes 0.0
    return np.where(bits < 0, bits ^ np.int64(np.iinfo(np.int64).max), bits)


def _double(key: int) -> float:
    bits = np.array([key], np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(np.iinfo(np.int64).max), bits).view(np.float64)[0])


def column_medians(rows: DataFrame, columns: Sequence[str], by: str | None = None, groups: Sequence[float] = (0.0,),
                   read: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray | None, np.ndarray]]] | None = None) -> dict[tuple[float, str], float]:
    """Exact medians of the finite values of many columns, per value in ``groups`` of the double column ``by``.

    ``rows`` is scanned a few times and must be a fixed intermediate result. A scan counts, per column and group, the values in
    ``BINS`` parts of the interval that the median is known to lie in, and the least and greatest of them; the next interval is
    the part that holds the median. At most nine scans reach a single double, discrete columns take about four, and one more
    finds the value above where the number of rows is even. Only counts are shuffled, so nothing grows with the rows.
    ``read`` yields groups and matrix (column by row) of the batches of ``rows`` where the caller keeps them in another form.
    """
    p, n_groups, columns = len(columns), len(groups), list(columns)
    size, known = p * n_groups, np.array(groups, float)
    full = np.iinfo(np.int64)
    held = rows
    if read is None:
        held = rows.select(*([F.col(by).cast("double").alias("_g")] if by else []), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)])

        def read(batches):
            number = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            for batch in batches:
                yield number(batch, "_g") if by else None, np.stack([number(batch, f"_x{i}") for i in range(p)])

    def scan(lo: np.ndarray, hi: np.ndarray, shift: np.ndarray) -> dict[int, tuple[np.ndarray, int, int]]:
        """Counts per part, least and greatest value of each (group, column) between ``lo`` and ``hi``."""
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, least, most = np.zeros((size, BINS), np.int64), np.full(size, full.max), np.full(size, full.min)
            for g, m in read(batches):
                for group, rows_of in enumerate([None] if g is None else [np.flatnonzero(g == v) for v in known]):
                    for i in range(p):
                        k = group * p + i
                        if lo[k] > hi[k] or rows_of is not None and not len(rows_of):
                            continue
                        x = m[i] if rows_of is None else m[i][rows_of]
                        key = _ordered(x[np.isfinite(x)])
                        key = key[(key >= lo[k]) & (key <= hi[k])]
                        if len(key):
                            part = ((key - lo[k]).view(np.uint64) >> shift[k]).astype(np.int64)
                            counts[k] += np.bincount(part, minlength=BINS)
                            least[k], most[k] = min(least[k], key.min()), max(most[k], key.max())
            full_ones = np.flatnonzero(counts.any(1))
            if len(full_ones):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full_ones, pa.int32()), pa.array(counts[full_ones].tolist(), pa.list_(pa.int64())),
                     pa.array(least[full_ones]), pa.array(most[full_ones])], ["k", "n", "least", "most"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": pdf["k"].iloc[:1], "n": [np.sum(np.stack(pdf["n"].to_list()), 0)], "least": pdf["least"].min(), "most": pdf["most"].max()})

        parts = held.mapInArrow(add_up, "k int, n array<long>, least long, most long")
        return {r["k"]: (np.array(r["n"]), r["least"], r["most"])
                for r in parts.groupBy("k").applyInPandas(merge, parts.schema).collect()}          # one row a group and column

    lo, hi = np.full(size, full.min), np.full(size, full.max)
    shift = np.full(size, 56, np.uint64)
    total, below, upto, found = np.zeros(size, np.int64), np.zeros(size, np.int64), {}, {}
    open_ = set(range(size))
    while open_:
        got = scan(lo, hi, shift)
        for k in list(open_):
            if k not in got:                                                # no value at all
                open_.discard(k)
                hi[k], lo[k] = full.min, full.max
                continue
            n, least, most = got[k]
            total[k] = total[k] or n.sum()
            if least == most:
                found[k], upto[k] = least, below[k] + n.sum()
                open_.discard(k)
                hi[k], lo[k] = full.min, full.max
                continue
            ahead = np.concatenate([[0], np.cumsum(n)])
            part = int(np.searchsorted(ahead, (total[k] - 1) // 2 - below[k], "right")) - 1
            start, width = int(lo[k]) + (part << int(shift[k])), 1 << int(shift[k])
            below[k] += ahead[part]
            lo[k], hi[k] = max(start, least), min(start + width - 1, most)
            shift[k] = max(0, (int(hi[k]) - int(lo[k])).bit_length() - 8)
    # The upper of the two middle values, where the lower one does not repeat.
    more = [k for k in found if total[k] % 2 == 0 and upto[k] <= total[k] // 2]
    above = {}
    if more:
        lo[more], hi[more], shift[more] = [found[k] + 1 for k in more], full.max, 56
        above = {k: least for k, (_, least, _) in scan(lo, hi, shift).items()}
    out = {}
    for k, key in found.items():
        a = _double(key)
        out[float(groups[k // p]), columns[k % p]] = 0.5 * a + 0.5 * _double(above[k]) if k in above else a
    return out
