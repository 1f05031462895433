"""A series cut into lanes gives the same answers as one window over the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.config import Config
from seriesloom.functions import lanes as lanes_mod
from seriesloom.functions.lanes import lay_out
from seriesloom.functions.quantile import quantiles
from seriesloom.operators import features as W
from seriesloom.operators import sessions as S
from seriesloom.operators.running_median import expanding_median, walk


@pytest.fixture(scope="module")
def readings(spark):
    """One series with more than a third of all rows, some short ones, and nulls."""
    rng = np.random.default_rng(5)
    parts = []
    for sid, n in [("hot", 600), ("a", 90), ("b", 41), ("c", 40), ("d", 3), ("e", 300)]:
        t = np.cumsum(rng.integers(1, 20, n)) * 3600
        sbp = np.round(140 + np.cumsum(rng.normal(0, 2, n)) + rng.normal(0, 5, n), 1)
        weight = np.where(rng.random(n) < 0.3, np.nan, np.round(70 + rng.normal(0, 2, n), 1))
        parts.append(pd.DataFrame(dict(series_id=sid, ts=pd.to_datetime("2024-01-01") + pd.to_timedelta(t, unit="s"),
                                       seq=np.arange(n), sbp=sbp, dbp=np.round(sbp * 0.55, 1), weight=weight,
                                       gap_value=np.where(rng.random(n) < 0.4, np.nan, sbp))))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf)
    return df.select("series_id", "ts", "seq", "sbp", "dbp", F.nanvl("weight", F.lit(None)).alias("weight"),
                     F.nanvl("gap_value", F.lit(None)).alias("gap_value"))


def _features(readings):
    ln = lay_out(readings, ["series_id"], ["ts", "seq"], reach=W.REACH)
    f = W.build_features(ln, Config())
    return ln, f


def test_features_do_not_depend_on_lanes(readings, monkeypatch):
    whole, plain = _features(readings)
    assert not whole.split
    plain = plain.toPandas().sort_values(["series_id", "step"]).reset_index(drop=True)
    monkeypatch.setattr(lanes_mod, "LANE_ROWS", 40)
    cut, f = _features(readings)
    assert cut.split
    got = f.toPandas().sort_values(["series_id", "step"]).reset_index(drop=True)
    assert len(got) == len(plain) == 1074 and set(got.columns) == set(plain.columns)
    for c in plain.columns:
        if c in ("series_id", "ts"):
            assert (got[c] == plain[c]).all()
        else:
            np.testing.assert_allclose(got[c].astype(float), plain[c].astype(float), rtol=1e-9, atol=1e-7, err_msg=c)


def test_pandas_agrees(readings):
    _, f = _features(readings)
    got = f.toPandas().sort_values(["series_id", "step"])
    for sid, g in got.groupby("series_id"):
        v = g.sbp.shift(1)
        for a, n in ((0.1, "sbp_ewm10"), (0.3, "sbp_ewm30")):
            np.testing.assert_allclose(g[n].astype(float), v.ewm(alpha=a, adjust=False).mean(), rtol=1e-10)
        np.testing.assert_allclose(g.sbp_std14.astype(float), v.rolling(14, min_periods=4).std(), rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose(g.sbp_base_std.astype(float), v.expanding(5).std(), rtol=1e-8, atol=1e-9)
        if g.weight.notna().sum() > 3:
            w = g.weight.astype(float).shift(1)
            np.testing.assert_allclose(g.weight_delta_base.astype(float), w - w.expanding(5).median(), atol=1e-9)


def test_smoothing_ages_over_nulls(readings, monkeypatch):
    for rows in (10**6, 40):
        monkeypatch.setattr(lanes_mod, "LANE_ROWS", rows)
        ln = lay_out(readings, ["series_id"], ["ts", "seq"], reach=2)
        assert ln.split == (rows == 40)
        got = ln.done(W.add_ewma(ln, ln.df, {"x": F.col("gap_value")}, (0.1, 0.3))).toPandas()
        for _, g in got.sort_values("step").groupby("series_id"):
            v = g.gap_value.astype(float).shift(1)
            for a, n in ((0.1, "x_ewm10"), (0.3, "x_ewm30")):
                np.testing.assert_allclose(g[n].astype(float), v.ewm(alpha=a, adjust=False).mean(), rtol=1e-10)


@pytest.mark.parametrize("chunk", [7, 64])
def test_running_median_of_long_series(readings, chunk):
    ln = lay_out(readings, ["series_id"], ["ts", "seq"])
    out = expanding_median(ln, ln.df, "weight", "m", least=5, short_rows=1, chunk_rows=chunk).toPandas()
    assert len(out) == 1074
    for _, g in out.sort_values("step").groupby("series_id"):
        w = g.weight.astype(float).shift(1)
        np.testing.assert_allclose(g.m.astype(float), w.expanding(5).median(), atol=1e-12)


def test_walk_matches_numpy():
    rng = np.random.default_rng(1)
    v = rng.normal(size=200)
    got = walk([], 0, 0, v, 1)
    assert np.isnan(got[0])
    np.testing.assert_allclose(got[1:], [np.median(v[:i]) for i in range(1, 200)])


def test_session_runs_across_lanes(readings, monkeypatch):
    def runs():
        r = S.number_runs(readings, "series_id", "ts", "seq", gap_hours=10)
        return r.select("series_id", "seq", "run").toPandas().sort_values(["series_id", "seq"]).reset_index(drop=True)
    plain = runs()
    monkeypatch.setattr(lanes_mod, "LANE_ROWS", 40)
    pd.testing.assert_frame_equal(runs(), plain)
    assert plain.run.max() > 50


@pytest.mark.parametrize("by", [[], ["series_id"]])
def test_quantiles_of_large_groups(readings, by):
    probs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "hi": 0.95, "top": 1.0}
    small = quantiles(readings, by, "sbp", probs).toPandas()
    large = quantiles(readings, by, "sbp", probs, bound=10**9, group_rows=30).toPandas()
    if by:
        small, large = (d.sort_values(by).reset_index(drop=True) for d in (small, large))
    pd.testing.assert_frame_equal(small[large.columns], large, check_exact=False)


@pytest.mark.parametrize("order", ["mixed", "rising", "falling", "equal"])
def test_median_slices_cost_no_grid(spark, order):
    """One series of 3000 rows in 150 chunks: every order gives the plain median, and few buckets are asked for."""
    from seriesloom.operators import running_median as R
    n, size = 3000, 20
    rng = np.random.default_rng(1)
    v = {"mixed": rng.normal(size=n).round(2), "rising": np.arange(n) / 7.0, "falling": -np.arange(n) / 7.0, "equal": np.full(n, 3.0)}[order]
    v[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"series_id": 1, "at": np.arange(n), "v": v})
    ln = lay_out(spark.createDataFrame(pdf), ["series_id"], ["at"])
    got = R.expanding_median(ln, ln.df.withColumn("v", F.nanvl("v", F.lit(None))), "v", "m", short_rows=1, chunk_rows=size).toPandas().sort_values("at")
    want = pd.Series(v).expanding(5).median().shift(1)
    assert np.allclose(got["m"].astype(float), want, equal_nan=True)

    known = pdf[~np.isnan(v)].assign(_chunk=lambda d: d["at"] // size)
    known["_vb"] = known.sort_values(["v", "at"]).assign(r=range(len(known)))["r"] // size
    extent = pd.DataFrame({"series_id": [1], "_c": [(n - 1) // size], "_b": [int(known["_vb"].max())]})
    found = R.locate(spark.createDataFrame(known[["series_id", "_chunk", "_vb"]]), spark.createDataFrame(extent), ["series_id"], size, 13)
    asked = found.agg(F.sum(F.col("_hi") - F.col("_lo") + 1)).first()[0]
    chunks = n // size
    assert asked < chunks * (np.log(chunks) + 4)            # the grid had 150 * 143 = 21,450 cells
