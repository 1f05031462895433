"""Joins that attach one row per key without a hot task.

A plain shuffle join sends all rows of a key to one task. ``attach`` counts the keys first: the few heavy ones are joined
with a broadcast of their own groups where they stand, and only the others are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.lanes import BROADCAST_KEYS
from seriesloom.lineage import pin

HEAVY_ROWS = 1_000_000       # rows of one key that a task may take in a shuffle join


def heavy_keys(rows: DataFrame, on: Sequence[str], heavy_rows: int | None = None) -> DataFrame | None:
    """The keys with more than ``heavy_rows`` rows, pinned; None if there are none.

    Should there be more than ``BROADCAST_KEYS`` of them, the limit rises to a ``BROADCAST_KEYS``-th of all rows, which
    so many keys at most can exceed: the list may always be broadcast.
    """
    heavy_rows = HEAVY_ROWS if heavy_rows is None else heavy_rows
    counts = rows.groupBy(*on).agg(F.count("*").alias("_rows"))
    n_heavy, total = counts.agg(F.count_if(F.col("_rows") > heavy_rows), F.sum("_rows")).first()
    if not n_heavy:
        return None
    limit = heavy_rows if n_heavy <= BROADCAST_KEYS else max(heavy_rows, total // BROADCAST_KEYS)
    return pin(counts.where(F.col("_rows") > limit).select(*on))


def attach(rows: DataFrame, groups: DataFrame, on: str | Sequence[str], how: str = "left", bound: int | None = None,
           heavy_rows: int | None = None) -> DataFrame:
    """``rows.join(groups, on, how)`` for ``groups`` with at most one row per key; ``how`` is left, inner, left_semi or left_anti.

    ``bound`` is a known upper bound of the rows per key. Where it is small the join is the plain one and nothing is
    counted; without it one narrow counting job over the key columns decides. Rows without a key are never shuffled.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"attach cannot join {how}")
    if bound is not None and bound <= (HEAVY_ROWS if heavy_rows is None else heavy_rows):
        return rows.join(groups, on, how)
    heavy = heavy_keys(rows, on, heavy_rows)
    if heavy is None:
        return rows.join(groups, on, how)
    heavy = F.broadcast(heavy)
    hot = rows.join(heavy, on, "left_semi").join(F.broadcast(groups.join(heavy, on, "left_semi")), on, how)
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    cold = rows.join(heavy, on, "left_anti")
    out = hot.unionByName(cold.where(known).join(groups, on, how))
    if how in ("left", "left_anti"):
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name not in on] if how == "left" else []
        out = out.unionByName(cold.where(~known).select("*", *more))
    return out
