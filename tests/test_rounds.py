"""What is read again and again is made once: rows of rounds, states of theta, pairs nobody asked for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import densities as D
from seriesloom.operators import forecast as B
from seriesloom.operators import heads as H
from seriesloom.operators import leakage as K
from seriesloom.operators import linear as N
from seriesloom.operators import stats as A


def counted(spark, df):
    """``df`` that counts how often its rows are made."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(count, df.schema), seen


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    d = pd.DataFrame(r.normal(size=(400, 2)), columns=["a", "b"])
    d["y"] = d["a"] - d["b"] + r.standard_t(2, 400)
    d["hit"] = (d["y"] > r.normal(size=400)).astype(float)
    d.loc[::7, "b"] = np.nan
    return spark.createDataFrame(d).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in d.columns]).repartition(3)


def test_packed_rows_come_back(rows, monkeypatch):
    monkeypatch.setattr(N, "PACK_BYTES", 8 * 4 * 30)                       # 30 rows a matrix
    whole = rows.toPandas()
    got = [m for part in N.packed(rows).toArrow().to_batches() for m in N.unpacked([part], 4)]
    assert max(map(len, got)) == 30
    order = lambda m: m[np.argsort(m[:, 0])]
    np.testing.assert_array_equal(order(np.concatenate(got)), order(whole.to_numpy()))


def huber(df, rounds):
    centre, labels = np.zeros(2), {"y": F.col("y")}
    N.huber(df, ["a", "b"], centre, labels, N.sums(df, ["a", "b"], centre, labels), rounds)


def logistic(df, rounds):
    H.logistic(df, ["a", "b"], np.zeros(2), {"hit": F.col("hit")}, rounds)


def mixtures(df, rounds):
    D.fit_mixtures(df, D.Shape(["a", "b"], np.zeros(2), np.zeros(2), np.ones(2), np.eye(2)), (2,), np.ones(2), rounds)


@pytest.mark.parametrize("fit", [huber, logistic, mixtures])
def test_more_rounds_do_not_make_the_rows_again(spark, rows, fit):
    few, n_few = counted(spark, rows)
    many, n_many = counted(spark, rows)
    fit(few, 1)
    fit(many, 4)
    assert n_few.value == n_many.value > 0


def test_theta_walks_its_states_once(spark):
    r = np.random.default_rng(2)
    table = [(s, i, float(r.integers(90, 160))) for s in range(3) for i in range(6)]
    states, seen = counted(spark, B.holt_states(spark.createDataFrame(table, "k long, at long, v double"), "k", ["at"], "v", [B.SES]))
    got = {(x.k, x.step): x.theta for x in B.theta_forecasts(states, "k", 1, bound=6).collect()}
    assert seen.value == len(table)
    for s in range(3):
        v = [x for k, _, x in table if k == s]
        level = v[0]
        for i in range(1, 6):
            want = v[i - 1] if i < 3 else level + 0.5 * (v[i - 1] - v[0]) / (i - 1)
            assert got[s, i] == pytest.approx(want)
            level = 0.3 * v[i] + 0.7 * level
        assert got[s, 0] is None


def test_pairs_with_the_last_column_only(rows):
    every = {(x.a, x.b): (x.n, x.r) for x in A.correlation_matrix(rows, ["a", "b", "hit", "y"]).collect()}
    for last in (1, 2):
        got = {(x.a, x.b): (x.n, x.r) for x in A.correlation_matrix(rows, ["a", "b", "hit", "y"], last).collect()}
        assert got.keys() == {(a, b) for a, b in every if b in ["a", "b", "hit", "y"][-last:]}
        assert all(got[k][0] == every[k][0] and got[k][1] == pytest.approx(every[k][1], abs=1e-12) for k in got)


def test_structural_audit_asks_for_pairs_with_the_signal(rows, monkeypatch):
    asked, whole = [], K.correlation_matrix
    monkeypatch.setattr(K, "correlation_matrix", lambda *a, **k: asked.append(whole(*a, **k)) or asked[-1])
    frame = rows.select("*", F.lit(1).alias("series_id"), F.monotonically_increasing_id().alias("step"), F.lit("train").alias("split"), F.lit("fit").alias("patient_split"),
                        F.col("y").alias("sbp"), F.col("a").alias("sbp_lag1"), F.col("a").alias("sbp_mean3"), *[F.col("y").alias(f"y_sbp_h{h}") for h in range(3)])
    K.structural_audit(frame, ["sbp_lag1", "sbp_mean3", "b"], before="a")
    assert asked[0].count() == 3


def test_medians_and_sums_of_packed_rows(spark):
    """What reads packed rows, with holes and infinities, equals what reads the rows, per group too."""
    from seriesloom.functions.quantile import column_medians
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(0, 3, (900, 2)), columns=["a", "b"])
    pdf.loc[rng.random(900) < 0.2, "a"] = np.nan
    pdf.loc[5, "b"] = np.inf
    pdf["g"] = rng.integers(0, 3, 900).astype(float)
    pdf["y"] = rng.normal(0, 1, 900)
    df = spark.createDataFrame(pdf).select(F.nanvl("a", F.lit(None)).alias("a"), "b", "g", "y").repartition(4)
    one, each = {"y": F.col("y")}, {str(k): F.when(F.col("g") == k, F.col("y")) for k in (0.0, 1.0, 2.0)}
    whole = N.pack(df, ["a", "b"], one)
    clean = pdf.replace(np.inf, np.nan)
    want = clean[["a", "b"]].median().to_numpy()
    np.testing.assert_allclose(N.medians(df, ["a", "b"], 10 ** 9, whole), want, rtol=1e-12)
    np.testing.assert_allclose(N.medians(df, ["a", "b"], 10 ** 9), want, rtol=1e-12)
    cells = N.pack(df, ["a", "b"], each)
    found = column_medians(cells.rows, ["a", "b"], "g", [0.0, 1.0, 2.0], cells.grouped({n: float(n) for n in each}))
    for k, part in clean.groupby("g"):
        np.testing.assert_allclose([found[k, "a"], found[k, "b"]], part[["a", "b"]].median().to_numpy(), rtol=1e-12)
    for labels, ready in ((one, whole), (each, cells)):
        a, b = N.sums(df, ["a", "b"], want, labels), N.sums(df, ["a", "b"], want, labels, cells=ready)
        for name in labels:
            use = clean if name == "y" else clean[clean.g == float(name)]
            z = np.column_stack([np.ones(len(use)), np.nan_to_num(use[["a", "b"]].to_numpy() - want), use.y])
            assert a[name].n == b[name].n == len(use)
            np.testing.assert_allclose(a[name].gram, z.T @ z, rtol=1e-9, atol=1e-9)
            np.testing.assert_allclose(b[name].gram, z.T @ z, rtol=1e-9, atol=1e-9)
