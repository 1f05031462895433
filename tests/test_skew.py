"""Attaching one row per key gives the same rows when a key is heavy, in the helper and wherever it is used."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriesloom.functions import lanes, skew
from seriesloom.plans import roles

#: Queries that attach a row per series, patient, day or rank, one for each place.
USERS = ["event_labels", "forecast_scores", "theta", "series_autoregression", "series_regression", "residual_intercepts", "alerts_personalised",
         "drift_advisories", "fluid_advisories", "contract_self_test", "request_errors", "panel", "static_join", "key_sets",
         "event_base_rates", "quantiles_by_selection", "threshold_search", "pressure_features"]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_equals_join(spark, how):
    rows = spark.range(400).select(
        F.when(F.col("id") % 10 > 0, 1).when(F.col("id") % 40 > 0, F.col("id") % 7).cast("long").alias("k"), "id")
    groups = spark.createDataFrame([(1, "one", 1.0), (2, None, 2.0), (3, "three", None), (9, "nine", 9.0)], "k long, name string, v double")
    want = sorted(map(str, rows.join(groups, "k", how).collect()))
    got = skew.attach(rows, groups, "k", how, heavy_rows=10)
    assert sorted(map(str, got.collect())) == want and got.columns == rows.join(groups, "k", how).columns
    assert sorted(map(str, skew.attach(rows, groups, "k", how).collect())) == want
    two = skew.attach(rows.withColumn("j", F.col("id") % 2), groups.withColumn("j", F.lit(0).cast("long")), ["k", "j"], how, heavy_rows=10)
    assert two.count() == rows.withColumn("j", F.col("id") % 2).join(groups.withColumn("j", F.lit(0).cast("long")), ["k", "j"], how).count()


def test_heavy_keys_are_never_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 4)
    rows = spark.range(1000).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 50).alias("k"))
    assert skew.heavy_keys(rows, ["k"], 5).count() == 1 and skew.heavy_keys(rows, ["k"], 5000) is None
    groups = spark.range(50).select(F.col("id").alias("k"))
    assert skew.attach(rows, groups, "k", "inner", heavy_rows=5).count() == 1000


def test_heavy_rows_are_not_shuffled(spark):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("k"), "id")
    plan = skew.attach(rows, spark.range(3).select(F.col("id").alias("k")), "k", heavy_rows=10)._jdf.queryExecution().executedPlan().toString()
    hot = plan.split("Union")[1].split("SortMergeJoin")[0]
    assert "BroadcastHashJoin" in hot


@pytest.fixture(scope="module")
def lopsided(sf, tmp_path_factory):
    """The tables with nine of ten events in one series."""
    folder = tmp_path_factory.mktemp("lopsided")
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", folder / name)
    events = pd.read_parquet(f"{sf}/events.parquet")
    events.loc[events["event_id"] % 10 != 0, "user_id"] = events["user_id"].min()
    events.to_parquet(folder / "events.parquet", coerce_timestamps="us", index=False)
    return str(folder)


@pytest.mark.parametrize("name", USERS)
def test_queries_do_not_depend_on_the_limit(spark, lopsided, monkeypatch, name):
    def rows():
        frame = entry.queries()[name](spark, lopsided)
        shown = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
        return sorted(map(str, frame.select(*sorted(frame.columns)).select(*[s for s in shown]).collect()))

    want = rows()
    heavy, found = skew.heavy_keys, []
    monkeypatch.setattr(skew, "HEAVY_ROWS", 5)
    monkeypatch.setattr(skew, "heavy_keys", lambda *a: found.append(heavy(*a)) or found[-1])
    assert rows() == want
    if name != "quantiles_by_selection":
        assert any(f is not None for f in found)
