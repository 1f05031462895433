"""Learners from shared normal equations against plain numpy, and the sweep's arms and failures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import learners as L
from seriesloom.operators import linear as N

XS = ["a", "b", "c", "flat", "none"]


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(8)
    n = 900
    d = pd.DataFrame({"a": r.normal(10, 3, n), "b": r.normal(-1, 1, n), "c": r.exponential(2, n), "flat": 4.0, "none": np.nan})
    d["b"] = d["b"].where(r.random(n) < 0.8)
    d["y1"] = 2 * d["a"] - 3 * d["b"].fillna(d["b"].median()) + r.normal(0, 1, n)
    d["y2"] = d["a"] + r.standard_t(1.5, n)
    d["y2"] = d["y2"].where(r.random(n) < 0.7)
    return d


@pytest.fixture(scope="module")
def fitted(spark, table):
    df = spark.createDataFrame(table).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in table.columns]).repartition(4)
    labels = {"one": F.col("y1"), "two": F.col("y2")}
    centre = N.medians(df, XS)
    return df, labels, centre, N.sums(df, XS, centre, labels)


def plain(table, y):
    known = table[table[y].notna()]
    x = known[XS].fillna(table[XS].median()).fillna(0.0).to_numpy()
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), known[y].to_numpy(), x


def shown(model, centre, x):
    return model.intercept + (x - centre) @ model.weights


@pytest.mark.parametrize("label, y", [("one", "y1"), ("two", "y2")])
def test_ridge_and_elastic_net(fitted, table, label, y):
    _, _, centre, sums = fitted
    z, t, x = plain(table, y)
    assert sums[label].n == len(t) and centre.tolist() == [table[c].median() if table[c].notna().any() else 0.0 for c in XS]
    w = np.linalg.solve(z.T @ z + N.RIDGE * np.eye(len(XS)), z.T @ (t - t.mean()))
    np.testing.assert_allclose(shown(N.ridge(sums[label], np.arange(5)), centre, x), z @ w + t.mean(), rtol=1e-6)
    p = shown(N.elastic_net(sums[label], np.arange(5)), centre, x)
    w = np.linalg.lstsq(z, p - p.mean(), rcond=None)[0]
    slope = z.T @ (t - p) / len(t) - N.ELASTIC * (1 - N.MIX) * w            # optimality of each coordinate
    on = np.abs(w) > 1e-8
    np.testing.assert_allclose(slope[on], N.ELASTIC * N.MIX * np.sign(w[on]), atol=1e-6)
    assert (np.abs(slope[~on]) <= N.ELASTIC * N.MIX + 1e-6).all()


def test_huber_resists_outliers(fitted, table):
    df, labels, centre, sums = fitted
    got = N.huber(df, XS, centre, labels, sums, rounds=40)
    z, t, x = plain(table, "y2")
    off = t - shown(got["two"], centre, x)
    scale = np.sqrt(np.where(np.abs(off) <= N.HUBER * 1.5, off ** 2, (N.HUBER * 1.5) ** 2).mean())
    for _ in range(200):
        near = np.abs(off) <= N.HUBER * scale
        scale = np.sqrt((off[near] ** 2).sum() / (len(t) - (~near).sum() * N.HUBER ** 2))
    pull = np.clip(off / scale, -N.HUBER, N.HUBER)
    assert np.abs(np.column_stack([np.ones(len(t)), z[:, :3]]).T @ pull).max() / len(t) < 1e-3      # no direction improves
    assert abs(got["two"].weights[0] - 1) < 0.1


def test_predictions_are_one_product(spark, fitted, table):
    df, _, centre, sums = fitted
    models = [N.ridge(sums["one"], np.arange(5)), N.ridge(sums["two"], np.array([0]))]
    rows = N.predict(df, XS, centre, models, ["a", "y1"]).toPandas().sort_values("a")
    x = table.sort_values("a")[XS].fillna(table[XS].median()).fillna(0.0).to_numpy()
    np.testing.assert_allclose(np.stack(rows["p"]), np.column_stack([shown(m, centre, x) for m in models]), rtol=1e-9)


def test_sweep_arms_and_failures(spark, monkeypatch):
    r = np.random.default_rng(3)
    n = 1600
    d = pd.DataFrame({"series_id": r.integers(0, 40, n), "sbp": r.normal(120, 10, n), "split": r.choice(["train", "val", "test"], n, p=[.6, .2, .2])})
    d["patient_split"] = np.where(d["series_id"] % 5 == 0, "holdout", "fit")
    for c in ("lag1", "lag2", "lag7", "base_mean", "ewm30"):
        d[f"sbp_{c}"] = d["sbp"] + r.normal(0, 5, n)
    d["y_sbp_h0"], d["y_sbp_h1"], d["y_sbp_h2"] = d["sbp"], np.nan, np.where(d.index % 3, d["sbp"], np.nan)
    df = spark.createDataFrame(d).select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in spark.createDataFrame(d).dtypes])
    long, notes = L.sweep(df, ["sbp_lag1", "sbp_lag2"], ["sbp"], [0, 1, 2], ["ridge", "ridge_own", "ridge_window_delta", "huber", "nonsense"])
    got = long.groupBy("arm", "h", "model").agg(F.count("*").alias("n"), F.count("p").alias("known")).toPandas()
    assert set(got["h"]) == {0, 2}                                          # h 1 has no label
    want = {"val": ((d.split == "val") & (d.patient_split == "fit")).sum(), "test": ((d.split == "test") & (d.patient_split == "fit")).sum(),
            "holdout_pt": ((d.split == "test") & (d.patient_split == "holdout")).sum()}
    assert {a: set(g["n"]) for a, g in got.groupby("arm")} == {a: {int(x)} for a, x in want.items()}
    assert {m for m in got["model"]} == {"ridge", "ridge_own", "ridge_window_delta", "huber", "persistence", "seasonal_naive_7", "drift", "personal_mean", "ewma"}
    assert [(x.h, x.model, "unknown learner" in x.note) for x in notes.orderBy("h").collect()] == [(0, "nonsense", True), (2, "nonsense", True)]
    error = long.where("model = 'ridge' AND y IS NOT NULL").agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]
    assert error < 4
    tiny, none = L.sweep(df.limit(100), ["sbp_lag1"], ["sbp"], [0], ["ridge"])
    assert tiny.count() == 0 and none.count() == 0


def test_missingness_refits_every_copy(spark):
    r = np.random.default_rng(5)
    n = 1500
    d = pd.DataFrame({"drop_frac": r.choice([0.0, 0.3, 0.9], n, p=[.5, .4, .1]), "split": r.choice(["train", "test"], n, p=[.7, .3]),
                      "a": r.normal(size=n), "b": r.normal(5, 2, n)})
    d["y"] = (3 + d["drop_frac"]) * d["a"] + d["b"] + r.normal(0, 0.5, n)
    d["b"] = d["b"].where(r.random(n) < 0.9)
    d["y"] = d["y"].where(r.random(n) < 0.95)
    df = spark.createDataFrame(d).select("split", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("drop_frac", "a", "b", "y")])
    got = L.missingness(df, ["a", "b"], "y", [0.0, 0.3, 0.9]).toPandas().set_index("drop_frac")
    for f in (0.0, 0.3):
        mine = d[(d.drop_frac == f) & d.y.notna()]
        train, test = mine[mine.split == "train"], mine[mine.split == "test"]
        fill = train[["a", "b"]].median()
        x, mean, sd = train[["a", "b"]].fillna(fill), train[["a", "b"]].fillna(fill).mean(), train[["a", "b"]].fillna(fill).std(ddof=0)
        z = ((x - mean) / sd).to_numpy()
        w = np.linalg.solve(z.T @ z + N.RIDGE * np.eye(2), z.T @ (train.y - train.y.mean()).to_numpy())
        p = ((test[["a", "b"]].fillna(fill) - mean) / sd).to_numpy() @ w + train.y.mean()
        assert (got.loc[f, "n_train"], got.loc[f, "n_test"]) == (len(train), len(test))
        np.testing.assert_allclose(got.loc[f, ["mae", "rmse"]].astype(float), [np.abs(test.y - p).mean(), np.sqrt(((test.y - p) ** 2).mean())], rtol=1e-6)
    assert got.loc[0.9, "note"] == "too few train rows" and np.isnan(got.loc[0.9, "mae"]) and got.loc[0.0, "delta"] == 0


def test_block_importance_deals_whole_rows(spark):
    r = np.random.default_rng(2)
    d = pd.DataFrame(r.normal(size=(301, 4)), columns=["a", "b", "c", "e"])
    d["y"] = 3 * d["a"] + d["b"]
    seen = []

    def score(rows):
        seen.append(rows)
        return rows.withColumn("p", 3 * F.col("a") + F.col("b"))
    blocks = {"ab": ["a", "b"], "c": ["c"], "b": ["b"]}
    got = {x.block: x for x in L.block_importance(score, spark.createDataFrame(d).repartition(3), ["a", "b", "c", "e"], "y", blocks).collect()}
    dealt = seen[0].toPandas()
    assert len(dealt) == 301 * (3 * 3 + 1)
    key = lambda x, cols: sorted(map(tuple, x[cols].to_numpy()))
    for k in range(3):
        ab = dealt[(dealt.block == 0) & (dealt.repeat == k)]
        assert key(ab, ["a", "b"]) == key(d, ["a", "b"]) and key(ab, ["c", "e", "y"]) == key(d, ["c", "e", "y"])   # pairs stay whole, all are dealt
        assert key(ab, ["a", "c"]) != key(d, ["a", "c"])
        other = dealt[(dealt.block == 2) & (dealt.repeat == k)]
        assert key(ab[["b", "y"]], ["b", "y"]) == key(other, ["b", "y"])                   # one partner for all blocks
    assert got["c"].mae_increase == 0 and got["ab"].mae_increase > got["b"].mae_increase > 0.5 and got["ab"].n_features == 2


def test_bijections():
    for n in (1, 2, 7, 12, 97, 360):
        for seed in range(5):
            a, b = L.bijection(n, seed)
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))
