"""Resampled means against a plain loop over rows and draws."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from seriesloom.operators import metrics as M


def plain(d, draws, seed):
    md5 = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % M.PRIME
    out = {}
    for g, part in d.dropna(subset=["v"]).groupby("g", dropna=False):
        means = []
        for k in range(draws):
            a, b = max(md5(f"{seed}:{k}:a"), 1), md5(f"{seed}:{k}:b")
            w = np.array([sum(((a * md5(f"{i}:{j}") + b) % M.PRIME) / M.PRIME >= e for e in M.POISSON_ONE) for i, j in zip(part["i"], part["j"])])
            if w.sum():
                means.append((w * part["v"]).sum() / w.sum())
        out[g] = (len(part), part["v"].mean(), *np.quantile(means, [0.025, 0.975]))
    return out


@pytest.mark.parametrize("groups, size", [(4096, 4096), (2, 7)])
def test_resampled_mean_equals_loop(spark, monkeypatch, groups, size):
    monkeypatch.setattr(M, "GROUPS", groups)
    monkeypatch.setattr(M, "SLICE", size)
    r = np.random.default_rng(2)
    d = pd.DataFrame({"g": r.choice(["a", "b", "c"], 200), "i": np.arange(200), "j": "x", "v": r.normal(size=200)})
    d.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(d.astype(object).where(d.notna(), None).astype({"i": int}), "g string, i long, j string, v double").repartition(5)
    got = {x.g: (x.n, x["mean"], x.lo, x.hi) for x in M.resampled_mean(df, ["g"], "v", ["i", "j"], draws=40, seed=7).collect()}
    want = plain(d, 40, 7)
    assert got.keys() == want.keys()
    for g in want:
        np.testing.assert_allclose(got[g], want[g], rtol=1e-9)


def test_weights_are_poisson():
    times, plus = M.draw_hashes(400, 42)
    x = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % M.PRIME for i in range(2000)])
    w = np.searchsorted(M.POISSON_ONE, (x[:, None] * times + plus) % M.PRIME / M.PRIME, side="right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 8
    assert np.abs(np.corrcoef(w.T[:40])[np.triu_indices(40, 1)]).max() < 0.12     # draws do not follow each other


def test_nothing_to_resample(spark):
    empty = spark.createDataFrame([], "g string, i long, v double")
    assert M.resampled_mean(empty, ["g"], "v", ["i"]).count() == 0 and M.paired(empty.withColumn("u", empty.v), ["g"], "v", "u", ["i"]).count() == 0
