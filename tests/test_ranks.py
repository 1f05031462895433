"""Rank correlation from cell counts against pandas, with holes, ties, constants and long pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import lanes, skew
from seriesloom.operators import selection as X
from seriesloom.operators import stats as A

FEATURES, TARGETS = ["few", "many", "same", "holes", "flag", "empty"], ["t1", "t2"]


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(4)
    n = 700
    d = pd.DataFrame({"few": r.integers(0, 5, n).astype(float), "many": r.normal(size=n), "same": 3.0, "flag": (r.random(n) < 0.9).astype(float), "empty": np.nan})
    d["holes"] = np.where(r.random(n) < 0.4, np.nan, d["many"].round(1))
    d["t1"] = np.where(r.random(n) < 0.2, np.nan, d["many"] + r.normal(size=n))
    d["t2"] = (d["few"] * 2 + r.integers(0, 3, n)).where(r.random(n) < 0.7)
    return d


def plain(d):
    out = {}
    for f in FEATURES:
        for t in TARGETS:
            both = d[[f, t]].dropna()
            if len(both):
                rx, ry = both[f].rank(), both[t].rank()
                rho = rx.corr(ry) if rx.std() > 0 and ry.std() > 0 else None
                out[f, t] = (len(both), rho)
    return out


@pytest.mark.parametrize("lane, heavy", [(1_000_000, 1_000_000), (50, 20)])
def test_spearman_equals_pandas(spark, table, monkeypatch, lane, heavy):
    monkeypatch.setattr(lanes, "LANE_ROWS", lane)
    monkeypatch.setattr(A, "LANE_ROWS", lane)
    monkeypatch.setattr(skew, "HEAVY_ROWS", heavy)
    df = spark.createDataFrame(table).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in table.columns])
    got = {(r.feature, r.target): (r.n, r.rho) for r in A.spearman(df, FEATURES, TARGETS).collect()}
    want = plain(table)
    assert got.keys() == want.keys()
    for k, (n, rho) in want.items():
        assert got[k][0] == n and (got[k][1] is None if rho is None else abs(got[k][1] - rho) < 1e-9)


def test_a_constant_column_correlates_with_nothing(spark, table):
    df = spark.createDataFrame(table.assign(zero=0.0, third=1 / 3)).select("zero", "third", "many", "few")
    got = {(r.a, r.b): r.r for r in A.correlation_matrix(df, ["zero", "third", "many", "few"]).collect()}
    assert all(r is None for (a, _), r in got.items() if a in ("zero", "third"))
    assert abs(got["many", "few"] - table["many"].corr(table["few"])) < 1e-9


def test_spearman_moves_values_once_per_column_not_per_pair(spark, table):
    plan = A.spearman(spark.createDataFrame(table), FEATURES, TARGETS)._jdf.queryExecution().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("lane", [1_000_000, 100])
def test_spearman_over_blocks_with_holes_at_their_ends(spark, monkeypatch, lane):
    """Warming features, targets ahead of the last rows, blocks without any value, infinities, both zeros."""
    monkeypatch.setattr(A, "LANE_ROWS", lane)
    r = np.random.default_rng(8)
    n = 5000
    at = np.arange(n) % 40
    d = pd.DataFrame({"many": r.normal(size=n), "few": r.integers(-3, 3, n) * 0.5, "same": 1.0, "flag": r.integers(0, 2, n) * -0.0})
    d["holes"] = d["many"].where(at > 6)
    d["empty"] = d["few"].where(at > 6)
    d["t1"] = (d["many"] + d["few"] + r.normal(size=n)).where(at < 39)
    d["t2"] = (d["t1"].round(1)).where(at < 37)
    d.loc[3000:4999, :] = np.nan
    df = spark.createDataFrame(d).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in d.columns]).withColumn("many", F.coalesce("many", F.lit(float("inf"))))
    got = {(x.feature, x.target): (x.n, x.rho) for x in A.spearman(df.repartition(2), FEATURES, TARGETS).collect()}
    assert got.keys() == plain(d).keys()
    for k, (rows, rho) in plain(d).items():
        assert got[k][0] == rows and (got[k][1] is None if rho is None else abs(got[k][1] - rho) < 1e-9)


def test_spearman_without_any_pair(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "x double, y double")
    assert A.spearman(df, ["x"], ["y"]).collect() == [] and A.spearman(df.limit(0), ["x"], ["y"]).collect() == []


def test_relevance_moves_values_once_per_column_and_weighs_both_correlations(spark, table):
    df = spark.createDataFrame(table).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in table.columns])
    got = X.relevance(df, FEATURES, TARGETS)
    assert "Generate" not in got._jdf.queryExecution().toString()
    pearson = {(f, t): table[f].corr(table[t]) for f in FEATURES for t in TARGETS if table[f].std() > 0}
    want = {f: max([abs(v or 0.0) for (g, t), (n, rho) in plain(table).items() if g == f and n >= 200
                    for v in (rho, pearson.get((f, t)))], default=0.0) for f in FEATURES}
    assert {x.feature: round(x.relevance, 9) for x in got.collect()} == {f: round(v, 9) for f, v in want.items()}
