"""One pass over the rows gives the features that windows give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.config import Config
from seriesloom.functions import lanes as lanes_mod
from seriesloom.functions.lanes import lay_out
from seriesloom.operators import features as W


@pytest.fixture(scope="module")
def rows(spark):
    """Long and short series, holes of any length, a constant one, a null key."""
    rng = np.random.default_rng(7)
    parts = []
    for sid, n in [("hot", 700), ("a", 90), ("b", 41), ("flat", 60), ("d", 3), ("e", 1), (None, 50)]:
        x = np.where(rng.random(n) < 0.2, np.nan, np.round(140 + rng.normal(0, 9, n), 1))
        x[20:75] = np.nan
        if sid == "flat":
            x = np.full(n, 131.3)
        t = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n) * 3600, unit="s")
        parts.append(pd.DataFrame(dict(series_id=sid, ts=t, seq=np.arange(n), sbp=x, dbp=np.round(rng.normal(80, 6, n), 1), weight=70 + rng.normal(0, 2, n),
                                       days_since_last=rng.integers(1, 9, n), heart_rate=rng.normal(70, 5, n), took_all_meds=rng.integers(0, 2, n),
                                       sym_any=rng.integers(0, 2, n), sym_pain=rng.integers(0, 2, n))))
    df = spark.createDataFrame(pd.concat(parts))
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in ("sbp", "dbp") else c for c in df.columns]).repartition(3)


@pytest.mark.parametrize("cut, batch", [(False, "17"), (True, "10000")])
def test_one_pass_equals_windows(spark, rows, monkeypatch, cut, batch):
    if cut:
        monkeypatch.setattr(lanes_mod, "LANE_ROWS", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        both = []
        for dense in (False, True):
            lanes = lay_out(rows, ["series_id"], ["ts", "seq"], reach=W.REACH)
            assert lanes.split == cut
            f = W.build_features(lanes, Config(), dense=dense)
            both.append((f.dtypes, f.toPandas().sort_values(["series_id", "step"]).reset_index(drop=True)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    (kinds, plain), (dense_kinds, dense) = both
    assert kinds == dense_kinds and len(plain) == len(dense) == 945
    for c, kind in kinds:
        if kind in ("string", "timestamp", "timestamp_ntz"):
            assert (plain[c].fillna("") == dense[c].fillna("")).all() if kind == "string" else (plain[c] == dense[c]).all()
        else:
            np.testing.assert_allclose(dense[c].astype(float), plain[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_without_smoothing_to_the_last_bit(rows):
    frames = []
    for dense in (False, True):
        lanes = lay_out(rows, ["series_id"], ["ts", "seq"], reach=W.REACH, bound=700)
        f = W.build_features(lanes, Config(), dense=dense, smooth=False)
        frames.append(f.toPandas().sort_values(["series_id", "step"]).reset_index(drop=True))
    plain, dense = frames
    pd.testing.assert_frame_equal(dense, plain, check_exact=True)


def test_one_pass_plans_fewer_windows(rows):
    """The windows over the rows are a few for running values and targets; those of frames are gone."""
    def frames(dense):
        lanes = lay_out(rows, ["series_id"], ["ts", "seq"], reach=W.REACH, bound=700)
        plan = W.build_features(lanes, Config(), dense=dense)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("windowspecdefinition(")
    assert frames(True) * 2 < frames(False)
