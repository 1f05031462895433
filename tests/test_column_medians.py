import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.functions.quantile import column_medians


def test_column_medians_equal_sorting(spark, monkeypatch):
    r = np.random.default_rng(3)
    n = 2001
    d = pd.DataFrame({"g": r.choice([0.0, 0.3, 0.5], n, p=[.6, .3, .1]), "wide": r.normal(size=n) * 10.0 ** r.integers(-200, 200, n),
                      "few": r.integers(-2, 3, n).astype(float), "holes": np.where(r.random(n) < 0.7, np.nan, r.normal(100, 1, n)),
                      "same": 7.5, "none": np.nan, "signs": r.choice([-0.0, 0.0, 1e-320, -1e308, 1e308], n)})
    df = spark.createDataFrame(d).select("g", *[F.nanvl(c, F.lit(None)).alias(c) for c in d.columns[1:]]).repartition(5)
    names = list(d.columns[1:])
    got = column_medians(df, names, "g", [0.0, 0.3, 0.9])
    for g in (0.0, 0.3):
        for c in names:
            mine = d.loc[d.g == g, c].dropna().to_numpy()
            assert got.get((g, c)) == (np.percentile(mine, 50) if len(mine) else None), (g, c)
    assert all(g in (0.0, 0.3) for g, _ in got)
    every, inf = column_medians(df, names), df.withColumn("few", F.lit(float("inf")))
    assert all(every[0.0, c] == np.median(d[c].dropna()) for c in names if c != "none") and (0.0, "none") not in every
    assert column_medians(inf.where("g = 0.5"), ["few"]) == {} and column_medians(df.where("false"), names) == {}


def test_large_inputs_scan_instead_of_unpivoting(spark, monkeypatch):
    from seriesloom.operators import learners as L, linear as N
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("a"), F.rand(1).alias("b"), F.rand(2).alias("y"),
                                  F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), F.lit(0.3).alias("drop_frac")).localCheckpoint()
    plain, sweep = N.medians(df, ["a", "b"]), L.missingness(df, ["a", "b"], "y", [0.3]).collect()
    def refuse(*a, **k):
        raise AssertionError("rows were unpivoted")
    monkeypatch.setattr(N, "unpivot", refuse)
    monkeypatch.setattr(L, "unpivot", refuse)
    many = 10_000_000
    assert (N.medians(df, ["a", "b"], many) == plain).all()
    assert [x.asDict() for x in L.missingness(df, ["a", "b"], "y", [0.3], many).collect()] == [x.asDict() for x in sweep]
