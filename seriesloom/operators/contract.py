"""The data contract: every check is an aggregate that can fail, and is shown to fail on corrupted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.config import GAP_HIGH, GAP_LOW, MAX_OUT_OF_RANGE, MIN_PULSE_PRESSURE, RANGES, STALE_DAYS
from seriesloom.functions.expr import share
from seriesloom.functions.lanes import Lanes, attach_row
from seriesloom.functions.quantile import quantiles
from seriesloom.functions.skew import attach
from seriesloom.operators.panel import model_gap, raw_gap

CHECK = "check string, ok boolean, value double, critical boolean"


def status() -> Column:
    return F.when(F.col("ok"), "PASS").when(F.col("critical"), "FAIL").otherwise("WARN")


def rows(one: DataFrame, checks: Sequence[tuple[str, Column, Column, bool]]) -> DataFrame:
    """Turn a one-row aggregate into check rows: (name, passes, observed value, critical)."""
    cells = [F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"),
                      v.cast("double").alias("value"), F.lit(c).alias("critical")) for n, ok, v, c in checks]
    return one.select(F.inline(F.array(*cells))).withColumn("status", status()).select("check", "status", "value", "critical")


def schema_checks(df: DataFrame, required: dict[str, str], optional: Sequence[str]) -> DataFrame:
    """Required columns exist with a usable type; absent optional ones warn. Only the schema is read."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    types = dict(df.dtypes)
    usable = {"number": lambda t: t.startswith(numeric), "datetime": lambda t: t in ("date", "timestamp", "timestamp_ntz"),
              "text": lambda t: True}
    out = []
    for c, kind in required.items():
        out.append((f"schema: '{c}' present", c in types, 0.0, True))
        if c in types:
            out.append((f"schema: '{c}' usable as {kind}", usable[kind](types[c]), 0.0, True))
    absent = [c for c in optional if c not in types]
    out.append(("schema: optional columns present", not absent, float(len(absent)), False))
    return df.sparkSession.createDataFrame(out, CHECK).withColumn("status", status()).select(
        "check", "status", "value", "critical")


def range_checks(df: DataFrame, ranges: dict[str, tuple] = RANGES, tolerance: float = MAX_OUT_OF_RANGE,
                 min_diff: float = MIN_PULSE_PRESSURE, critical: bool = False) -> DataFrame:
    """Share of known values outside each range, and of rows whose two vitals lie too close."""
    known = {c: b for c, b in ranges.items() if c in df.columns}
    one = df.agg(*[F.avg((~F.col(c).between(*b)).cast("double")).alias(c) for c, b in known.items()],
                 F.avg((F.col("sbp") - F.col("dbp") < min_diff).cast("double")).alias("_pp"))
    checks = [(f"range: {c} in [{lo}, {hi}]", F.col(c).isNull() | (F.col(c) < tolerance), F.col(c), critical)
              for c, (lo, hi) in known.items()]
    return rows(one, [*checks, ("range: pulse pressure", F.col("_pp") < tolerance, F.col("_pp"), critical)])


def structure_checks(lanes: Lanes, df: DataFrame, min_sessions: int, ts="ts") -> DataFrame:
    """Unique keys, order, positive gaps, rare clipping and staleness, no filled runs, long enough series.

    ``df`` is in panel order (``step``); its ``ts`` may be out of order, which is what the check looks for.
    """
    key = lanes.key
    w = lanes.window
    prev = lambda c: F.lag(c).over(w)
    d = df.select(*df.columns, (F.col(ts) < prev(ts)).alias("_back"),
                  ((F.col("sbp") == prev("sbp")) & (F.col("dbp") == prev("dbp"))
                   & (F.col("days_since_last_raw") == 1)).alias("_flat"))
    raw = F.col("days_since_last_raw")
    known = lambda c: F.avg(F.when(raw.isNotNull(), c.cast("double")))
    one = lanes.done(d).agg(F.count_if("_back").alias("back"), F.count_if(raw <= 0).alias("nonpos"),
                            known(raw > GAP_HIGH).alias("clipped"), known(raw > STALE_DAYS).alias("stale"),
                            share(F.col("_flat")).alias("flat"))
    plain = lanes.done(df)
    dup = plain.groupBy(*key, ts).count().agg(F.sum(F.col("count") - 1).alias("dup"))
    short = plain.groupBy(*key).count().agg(F.count_if(F.col("count") < min_sessions).alias("short"))
    one = attach_row(attach_row(one, dup), short)
    c = F.col
    return rows(one, [
        ("structure: unique (series, session)", c("dup") == 0, c("dup"), True),
        ("structure: timestamps increasing within series", c("back") == 0, c("back"), True),
        ("structure: session gaps strictly positive", c("nonpos") == 0, c("nonpos"), True),
        ("structure: the clip is a guard, not a transform", F.coalesce(c("clipped"), F.lit(0.0)) < 0.01, c("clipped"), True),
        ("structure: stale gaps are rare", F.coalesce(c("stale"), F.lit(0.0)) < MAX_OUT_OF_RANGE, c("stale"), False),
        ("structure: no forward-filled runs", c("flat") < 0.05, c("flat"), True),
        ("structure: every series is long enough", c("short") == 0, c("short"), True)])


def reconciliation_checks(sessions: DataFrame, published: DataFrame, band=(1.10, 1.30), max_without=0.25,
                          hours=(2.0, 6.0), bound: int | None = None) -> DataFrame:
    """Session count against a published one (one-row frame ``published``), record share, median duration."""
    one = sessions.agg(F.count("*").alias("n"), F.avg((F.col("session_source") != "d1").cast("double")).alias("without"))
    one = attach_row(attach_row(one, published), quantiles(sessions, [], "session_hours", {"hours": 0.5}, bound))
    r = F.col("n") / F.greatest(F.col("published"), F.lit(1))
    return rows(one.withColumn("ratio", r), [
        ("reconciliation: session ratio in band", F.col("ratio").between(*band), F.col("ratio"), True),
        ("reconciliation: sessions carry a record", F.col("without") <= max_without, F.col("without"), True),
        ("reconciliation: median duration", F.col("hours").between(*hours), F.col("hours"), False)])


def referential_checks(panel: DataFrame, key="series_id", ts="ts", static=("gender", "age")) -> DataFrame:
    """Static data found, the merge duplicated nothing, static values constant per series."""
    one = panel.agg(F.count_if(F.col("age").isNull()).alias("unmatched"))
    dup = panel.groupBy(key, ts).count().agg(F.sum(F.col("count") - 1).alias("dup"))
    vary = panel.groupBy(key).agg(*[(F.min(c) != F.max(c)).cast("int").alias(c) for c in static]).agg(
        F.coalesce(F.max(F.greatest(*static)), F.lit(0)).alias("vary"))
    one = attach_row(attach_row(one, dup), vary)
    return rows(one, [("join: demographics matched", F.col("unmatched") == 0, F.col("unmatched"), False),
                      ("join: merge did not duplicate rows", F.col("dup") == 0, F.col("dup"), True),
                      ("join: demographics constant within series", F.col("vary") == 0, F.col("vary"), False)])


def enforce(checks: DataFrame) -> None:
    """Raise when a critical check failed; the check table is a few rows."""
    failed = [r["check"] for r in checks.where("status = 'FAIL'").collect()]
    if failed:
        raise AssertionError("data contract violated: " + "; ".join(failed))


def cadence_audit(lanes: Lanes, df: DataFrame, features: Sequence[str] = (), ts="ts") -> DataFrame:
    """Seven probes over the gap columns."""
    if "days_since_last_raw" not in df.columns:
        spark = df.sparkSession
        return spark.createDataFrame([("raw gap is present", False, 0.0, True)], CHECK).withColumn(
            "status", status()).select("check", "status", "value", "critical")
    d = df.withColumn("_raw", raw_gap(lanes, ts)).withColumn("_gap", model_gap("_raw"))
    raw, gap = F.col("days_since_last_raw"), F.col("days_since_last")
    known = lambda c: F.coalesce(F.avg(F.when(raw.isNotNull(), c.cast("double"))), F.lit(0.0))
    one = lanes.done(d).agg(F.max(F.abs(gap - F.col("_gap"))).alias("off"), F.min(gap).alias("lo"), F.max(gap).alias("hi"),
                            F.count_if(raw <= 0).alias("nonpos"), known(raw > GAP_HIGH).alias("over"),
                            known(raw > STALE_DAYS).alias("stale"))
    leak = "days_since_last_raw" in features
    c = F.col
    return rows(one, [("raw gap is present", F.lit(True), F.lit(1.0), True),
                      ("raw gap is not a feature", F.lit(not leak), F.lit(float(leak)), True),
                      ("gap equals its recomputation", c("off") <= 1e-9, c("off"), True),
                      ("gap stays inside the bounds", (c("lo") >= GAP_LOW) & (c("hi") <= GAP_HIGH), c("hi"), True),
                      ("raw gaps are positive", c("nonpos") == 0, c("nonpos"), True),
                      ("the clip is a guard", c("over") < 0.01, c("over"), True),
                      ("stale gaps are rare", c("stale") < 0.005, c("stale"), False)])


def corruptions(panel: DataFrame, key="series_id", ts="ts", bound: int | None = None) -> dict[str, tuple[DataFrame, str]]:
    """Damaged copies of a panel, each with the check that has to catch it."""
    last = panel.groupBy(key).agg(F.max("step").alias("_last"))
    marked = attach(panel, last, key, "inner", bound)
    at = F.col("step")
    moved = F.when(at == F.floor(F.col("_last") / 2), F.date_sub(ts, 400)).otherwise(F.col(ts))
    late = F.when(at >= F.floor(F.col("_last") / 2), F.date_add(ts, 365)).otherwise(F.col(ts))
    first = panel.groupBy(key).agg(F.min(ts).alias("_first"))
    daily = attach(panel, first, key, "inner", bound).withColumn(ts, F.date_add("_first", at.cast("int"))).drop("_first")
    dup = marked.where(at == F.col("_last")).withColumn("step", at + 1)
    return {
        "duplicate last row": (panel.unionByName(dup.drop("_last")), "structure: unique (series, session)"),
        "timestamp moved back": (marked.withColumn(ts, moved).drop("_last"), "structure: timestamps increasing within series"),
        "one long gap": (marked.withColumn(ts, late).drop("_last"), "structure: the clip is a guard, not a transform"),
        "filled daily grid": (daily.withColumn("sbp", F.lit(140.0)).withColumn("dbp", F.lit(80)),
                              "structure: no forward-filled runs"),
        "too few sessions": (panel.where(at < 5), "structure: every series is long enough")}


def self_test(panel: DataFrame, min_sessions: int, key="series_id", ts="ts", bound: int | None = None) -> DataFrame:
    """Feed every damaged copy through the same checks; each must FAIL."""
    from seriesloom.functions.lanes import lay_out
    out = None
    for name, (damaged, expected) in corruptions(panel, key, ts, bound).items():
        lanes = lay_out(damaged.drop("days_since_last_raw", "days_since_last").withColumnRenamed("step", "_step"),
                        [key], ["_step"], reach=1, bound=bound)
        d = lanes.df.withColumn("days_since_last_raw", raw_gap(lanes, ts))
        got = structure_checks(lanes, d, min_sessions, ts).where(F.col("check") == expected)
        one = got.select(F.lit(name).alias("corruption"), "check", "status", (F.col("status") == "FAIL").alias("caught"))
        out = one if out is None else out.unionByName(one)
    return out


def verify_reports(reports: dict[str, DataFrame | None], assertions: dict[str, tuple[str, Column]]) -> DataFrame:
    """PASS or FAIL per assertion over a report table; a missing or empty report is a WARN, never a PASS.

    ``assertions`` maps a name to (report, aggregate column that must be true).
    """
    spark = next(r.sparkSession for r in reports.values() if r is not None)
    out = None
    for name, (report, ok) in assertions.items():
        table = reports.get(report)
        if table is None:
            one = spark.createDataFrame([(name, "WARN")], "name string, status string")
        else:
            one = table.agg(F.count("*").alias("n"), ok.alias("ok")).select(
                F.lit(name).alias("name"), F.when(F.col("n") == 0, "WARN").when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out
