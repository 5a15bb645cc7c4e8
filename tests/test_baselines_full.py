"""The eight models of the baseline comparison."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosscut import config
from crosscut.plans import research
from crosscut.queries import registry
from tests.test_research import panel_of


def test_optimised_models_carry_each_folds_own_weights(spark):
    df = panel_of(spark).withColumn("group_trend", -F.col("group_trend"))
    folds = spark.createDataFrame([(0, dt.date(2025, 1, 1), dt.date(2025, 1, 12)), (1, dt.date(2025, 1, 13), dt.date(2025, 12, 31))], "fold long, test_start date, test_end date")
    alone = lambda g: [1.0 if x == g else 0.0 for x in config.GROUPS]
    picks = lambda *gs: spark.createDataFrame([(i, *alone(g)) for i, g in enumerate(gs)], "fold long, " + ", ".join(f"w_{g} double" for g in config.GROUPS))
    optimized = research.optimized_weights(picks("momentum", "trend"), picks("trend", "momentum"))
    got = {(r["fold"], r["model"]): r["mean_rank_ic"] for r in research.baseline_comparison(df, folds, research.baseline_weights(spark), optimized).collect()}
    assert len(got) == 16
    for fold, (a, b) in enumerate((("momentum", "trend"), ("trend", "momentum"))):
        assert got[fold, "optimized_penalized"] == pytest.approx(got[fold, f"{a}_only"]) and got[fold, "optimized_ic_only"] == pytest.approx(got[fold, f"{b}_only"])


def test_baselines_score_the_rows_that_the_grid_did(spark, monkeypatch):
    """The complete panel is made once for the grid and the baselines; picks are made once each."""
    folder, made, walked, right = "/root/testdata/sf0.001", [], [], research.walk_forward
    small = panel_of(spark, dates=80, n=60).withColumn("group_trend", -F.col("group_trend"))
    monkeypatch.setattr(registry, "panel", lambda *_, **__: made.append(1) or small)
    monkeypatch.setattr(research, "walk_forward", lambda *a, **k: walked.append(1) or right(*a, **k))
    monkeypatch.setattr(research, "weight_grid", lambda spark, *_: weights)
    alone = [(i, *[1.0 if x == g else 0.0 for x in config.GROUPS]) for i, g in enumerate(config.GROUPS)]
    weights = spark.createDataFrame(alone, "candidate_id int, " + ", ".join(f"w_{g} double" for g in config.GROUPS))
    monkeypatch.setattr("crosscut.materialize._kept", {})
    got = registry.QUERIES["baseline_comparison_full_grid"](spark, folder).collect()
    assert len(made) == 1 and len(walked) == 2 and len(got) == 8 and {r["fold"] for r in got} == {0}
    assert all(r["mean_rank_ic"] == (-1 if r["model"] == "trend_only" else 1) for r in got)
