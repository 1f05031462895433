"""Checks and summaries of whole frames: structure, digest, provenance of key sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def missing_columns(df: DataFrame, declared: Sequence[str]) -> list[str]:
    return sorted(set(declared) - set(df.columns))


def has_columns(df: DataFrame, declared: Sequence[str]) -> bool:
    return not missing_columns(df, declared)


def find_columns(df: DataFrame, candidates: Sequence[str], fragments: Sequence[str] = ()) -> list[str]:
    """Columns present under a known name, or holding a fragment; only the schema is read."""
    names = [c.strip().lower() for c in df.columns]
    return [c for c in names if c in candidates or any(f in c for f in fragments)]


def digest(df: DataFrame) -> DataFrame:
    """Content hash that ignores column and row order, with the row and column count."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    hashed = df.select(row.alias("_h"))
    return hashed.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                      F.bit_xor("_h").alias("hash_xor"),
                      F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def provenance(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Are two cohorts disjoint, and do alerts stay inside their own cohort?

    ``sets`` holds id frames (column ``id``): real, other, real_alerts, other_alerts.
    """
    ids = {n: d.select(F.col("id").cast("string").alias("id")).distinct() for n, d in sets.items()}
    checks = [
        ("cohorts_disjoint", ids["real"].join(ids["other"], "id", "left_semi")),
        ("real_alerts_are_real", ids["real_alerts"].join(ids["real"], "id", "left_anti")),
        ("other_alerts_are_other", ids["other_alerts"].join(ids["other"], "id", "left_anti")),
        ("no_other_id_in_real_alerts", ids["real_alerts"].join(ids["other"], "id", "left_semi"))]
    out = None
    for name, offending in checks:
        one = offending.agg(F.count("*").alias("n_offending")).select(
            F.lit(name).alias("check"), "n_offending", (F.col("n_offending") == 0).cast("int").alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out
