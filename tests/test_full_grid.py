"""The registered queries on the production grid, over a small panel."""

import pytest
from pyspark.sql import functions as F

from crosscut.plans import research
from crosscut.queries import registry
from tests.test_research import panel_of


@pytest.fixture
def small(spark, monkeypatch):
    df = panel_of(spark, dates=80, n=50).withColumns({"group_trend": -F.col("group_trend"), "group_risk": F.pmod(F.col("group_risk") * 7, F.lit(50.0))}).cache()
    monkeypatch.setattr(registry, "panel", lambda *_: df)


def test_all_candidates(spark, small):
    got = registry.QUERIES["candidate_aggregate_full_grid"](spark, "").collect()
    assert sorted(r["candidate_id"] for r in got) == list(range(1001))
    assert registry.QUERIES["ic_only_pick_full_grid"](spark, "").count() == 1
