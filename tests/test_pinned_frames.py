"""Queries that scan their feature frame several times build it once."""

import pytest

from seriesloom.operators import detectors as D
from seriesloom.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["abstention", "drift_monitor", "detector_scorecard", "fused_weighted"])
def test_the_answer_reads_the_pinned_frame(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "parquet" not in text and "lag(" not in text


@pytest.mark.parametrize("name", ["banners", "fairness_battery"])
def test_the_serving_cut_reads_the_pinned_frame(spark, sf, monkeypatch, name):
    seen, cut = [], D.serving_cut
    monkeypatch.setattr(D, "serving_cut", lambda df, *a: seen.append(plan(df)) or cut(df, *a))
    catalog.QUERIES[name](spark, sf)
    assert seen and all("parquet" not in t and "lag(" not in t for t in seen)
