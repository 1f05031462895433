"""Ensemble weights come from rows that the legs have not seen, and nothing else."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import forecast as B
from seriesloom.operators import linear
from seriesloom.operators import stacking as K


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(9)
    n, per = 1200, 40
    d = pd.DataFrame({"series_id": np.arange(n) // per, "at": np.arange(n) % per, "a": r.normal(size=n), "b": r.normal(size=n)})
    d["split"] = np.where(d["at"] < 28, "train", np.where(d["at"] < 34, "val", "test"))
    d["patient_split"] = np.where(d["series_id"] % 6 == 0, "holdout", "fit")
    truth = 2 * d["a"] + d["b"]
    d["y"] = truth + r.normal(0, 1, n)
    d["holt"] = (truth + r.normal(0, 0.7, n)).where(d["at"] > 0)
    return d


def frame(spark, d):
    return spark.createDataFrame(d).select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in spark.createDataFrame(d).dtypes])


def test_weights_equal_a_plain_refit(spark, table):
    rows, weights = K.ensembles(frame(spark, table), ["a", "b"], "y", ["at"], "holt", keep=["at"], kinds=["ridge"])
    train = table[(table.split == "train") & (table.patient_split == "fit")]
    early = train["at"] + 1 <= 0.75 * 28

    def ridge(fit, on):
        x = (fit[["a", "b"]] - fit[["a", "b"]].mean()) / fit[["a", "b"]].std(ddof=0)
        w = np.linalg.solve(x.T @ x + linear.RIDGE * np.eye(2), x.T @ (fit.y - fit.y.mean()))
        return ((on[["a", "b"]] - fit[["a", "b"]].mean()) / fit[["a", "b"]].std(ddof=0)).to_numpy() @ w + fit.y.mean()

    check = train[~early].copy()
    p = np.column_stack([ridge(train[early], check), check["holt"]])
    error = np.abs(p - check[["y"]].to_numpy()).mean(axis=0)
    np.testing.assert_allclose(weights["ens_inv_mae"], (1 / error) / (1 / error).sum(), rtol=1e-6)
    w = np.linalg.lstsq(p, check["y"].to_numpy(), rcond=None)[0]
    assert (w > 0).all()
    np.testing.assert_allclose(weights["ens_stack"], w / w.sum(), rtol=1e-6)
    got = rows.toPandas()
    assert set(got["arm"]) == {"val", "test", "holdout_pt"} and got.loc[got.arm == "holdout_pt", "at"].min() >= 34
    mean = got[["ridge", "holt"]].mean(axis=1)
    np.testing.assert_allclose(got["ens_mean"], mean)
    np.testing.assert_allclose(got["ens_stack"], (got[["ridge", "holt"]] * weights["ens_stack"]).sum(axis=1))
    joined = got.merge(table, on=["series_id", "at"])
    np.testing.assert_allclose(joined["ridge"], ridge(train, joined), rtol=1e-6)


def test_validation_and_test_rows_do_not_move_the_weights(spark, table):
    bent = table.copy()
    late = bent["split"] != "train"
    bent.loc[late, "y"] = 1000.0
    bent.loc[late, "holt"] = -1000.0
    one = K.ensembles(frame(spark, table), ["a", "b"], "y", ["at"], "holt", kinds=["ridge"])[1]
    two = K.ensembles(frame(spark, bent), ["a", "b"], "y", ["at"], "holt", kinds=["ridge"])[1]
    assert one == two


def test_few_rows_give_the_mean(spark, table):
    rows, weights = K.ensembles(frame(spark, table[table["series_id"] < 5]), ["a"], "y", ["at"], "holt", kinds=["ridge"])
    assert weights == {"ens_inv_mae": None, "ens_stack": None}
    assert rows.where(F.abs(F.col("ens_stack") - F.col("ens_mean")) > 1e-12).count() == 0


def test_no_leg_gets_a_negative_weight():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    y = x[:, 0] - 0.5 * x[:, 1]
    g = x.T @ x
    sums = {f"g{i}_{j}": g[i, j] for i in range(3) for j in range(i, 3)} | {f"b{i}": (x.T @ y)[i] for i in range(3)}
    w = B.stacked_weights(sums, 3)
    assert min(w) >= 0 and abs(sum(w) - 1) < 1e-9 and w[1] == 0
