"""Scalar column expressions: rounding, clipping, hashing, cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """Null stays null (``least``/``greatest`` alone would return the bound)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def half_even(c, digits: int = 0) -> Column:
    """Round half to even, as numpy and pandas do."""
    return F.bround(col(c), digits)


def ratio(a, b) -> Column:
    """Division where a zero or null denominator gives null."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def finite(c) -> Column:
    """NaN and infinities become null."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def share(condition: Column) -> Column:
    """Share of rows where the condition holds, nulls counting as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def first_of(*cases: tuple[Column, object], default=None) -> Column:
    """CASE WHEN in the given order."""
    head, rest = cases[0], cases[1:]
    out = F.when(head[0], head[1])
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(default)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bucket(key, salt: str = "", buckets: int = 100) -> Column:
    """Salted md5 bucket of a key: first eight hex digits modulo ``buckets``."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def entity_split(key, holdout: float, salt: str = "patient-split") -> Column:
    return F.when(bucket(key, salt) < round(holdout * 100), "holdout").otherwise("fit")


def age_band(age) -> Column:
    a = col(age)
    return first_of((a.isNull() | (a < 0) | (a >= 200), None), (a < 50, "<50"), (a < 65, "50-64"),
                    (a < 75, "65-74"), default="75+")


def cohort_key(age, is_male) -> Column:
    """``band|sex``; a missing age counts as 65."""
    a = F.coalesce(col(age), F.lit(65.0))
    band = first_of((a < 50, "<50"), (a < 65, "50-64"), (a < 75, "65-74"), default="75+")
    return F.concat_ws("|", band, F.when(col(is_male).cast("int") == 1, "M").otherwise("F"))


def day_gap(later, earlier) -> Column:
    """Whole days between two timestamps, rounded down."""
    micros = F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000.0))


def seconds_between(later, earlier) -> Column:
    micros = F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))
    return micros / F.lit(1_000_000.0)
