"""Cross-sections, grid, walk-forward, streaming, and the entry point."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosscut import config
from crosscut.operators import crosssection
from crosscut.plans import panel, research
from crosscut.streaming import ticks


def panel_of(spark, signal=lambda i: float(i), dates=4, n=100):
    rows = [(dt.date(2025, 1, 3) + dt.timedelta(weeks=w), f"S{i:03d}", *[signal(i)] * 5, i / 1000, dt.datetime(2025, 1, 31) + dt.timedelta(weeks=w), True) for w in range(dates) for i in range(n)]
    return spark.createDataFrame(rows, "session_date date, symbol string, " + ", ".join(f"group_{g} double" for g in config.GROUPS) + ", forward_return_20d double, forward_end_20d timestamp, scoring_complete boolean")


def snapshot(spark, n=100):
    return spark.createDataFrame([(f"S{i:03d}", *[None if i == 0 and k == 0 else float(i + k) for k in range(20)]) for i in range(n)], "symbol string, " + ", ".join(f"{f} double" for f in config.SCORING_FEATURES))


def test_standard_scores(spark):
    pdf = panel.scoring_snapshot(snapshot(spark)).toPandas().sort_values("symbol").reset_index(drop=True)
    f = config.SCORING_FEATURES[1]
    x = pdf[f].clip(pdf[f].quantile(0.01), pdf[f].quantile(0.99))
    np.testing.assert_allclose(pdf[f"z_{f}"], (x - x.mean()) / x.std(ddof=0), rtol=1e-12)
    assert pdf.z_volatility_20d.iloc[0] > pdf.z_volatility_20d.iloc[-1]
    first = config.SCORING_FEATURES[0]
    assert np.isnan(pdf[f"z_{first}"].iloc[0]) and pdf[f"missing_{first}"].iloc[0] and pdf.scoring_missing_count.iloc[0] == 1 and not pdf.scoring_complete.iloc[0] and pdf.scoring_complete.iloc[1]
    crosssection.guard_no_scores(panel.scoring_snapshot(snapshot(spark)))
    with pytest.raises(ValueError, match="scores"):
        crosssection.guard_no_scores(snapshot(spark).withColumn("rank", F.lit(1)))


@pytest.mark.parametrize(("n", "filled"), [(49, 0), (50, 50)])
def test_smallest_cross_section(spark, n, filled):
    assert panel.scoring_snapshot(snapshot(spark, n)).filter(f"z_{config.SCORING_FEATURES[3]} IS NOT NULL").count() == filled


def test_no_spread_no_score(spark):
    df = snapshot(spark).withColumn("atr_pct_14", F.lit(1.0))
    assert panel.scoring_snapshot(df).filter("z_atr_pct_14 IS NOT NULL").count() == 0


def test_ranks_against_pandas(spark):
    x = [3.0, 1.0, 3.0, None, 2.0, 1.0, 3.0]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x)], "i int, g int, x double")
    got = df.select("i", crosssection.average_rank("x", "g").alias("a"), crosssection.percentile_rank("x", "g").alias("p")).toPandas().sort_values("i")
    np.testing.assert_allclose(got.a.to_numpy(float), pd.Series(x).rank().to_numpy(), equal_nan=True)
    np.testing.assert_allclose(got.p.to_numpy(float), pd.Series(x).rank(pct=True).to_numpy(), equal_nan=True)


def test_grid_and_composite(spark):
    grid = research.weight_grid(spark).toPandas()
    assert len(grid) == 1001 and np.allclose(grid.filter(like="w_").sum(axis=1), 1) and grid.iloc[0].w_participation == 1
    with pytest.raises(ValueError):
        research.weight_grid(spark, 0.3)
    df = panel_of(spark, n=1, dates=1).withColumn("group_risk", F.lit(None).cast("double"))
    assert df.select(crosssection.composite({g: 0.0 for g in config.GROUPS})).first()[0] is None


def test_perfect_signal(spark):
    df = panel_of(spark).withColumn("score", crosssection.composite({g: 0.2 for g in config.GROUPS}))
    rows = crosssection.signal_metrics(df, "score", "forward_return_20d").orderBy("session_date").collect()
    assert all(r["rank_ic"] > 0.99 and r["top_bottom_spread"] == pytest.approx(0.08) for r in rows)
    assert [r["turnover"] for r in rows] == [None, 0, 0, 0]


def test_ties_and_skipped_dates(spark):
    df = panel_of(spark, signal=lambda i: 0.0).withColumn("score", F.lit(1.0))
    single, stable = (crosssection.signal_metrics(df, "score", "forward_return_20d", ties=t).first() for t in ("symbol", "stable"))
    assert single["rank_ic"] is None and single["top_bottom_spread"] == pytest.approx(-0.08) and stable["top_bottom_spread"] == pytest.approx(0.08)
    gap = panel_of(spark).withColumn("score", F.col("group_risk")).filter("NOT (session_date = DATE'2025-01-10' AND symbol < 'S060')")
    rows = crosssection.signal_metrics(gap, "score", "forward_return_20d").orderBy("session_date").collect()
    assert len(rows) == 3 and rows[1]["turnover"] == 0


@pytest.mark.parametrize("signal", [lambda i: float(i), lambda i: float(i // 10), lambda i: float(i * 37 % 11)])
def test_kernel_agrees_with_operators(spark, signal):
    df = panel_of(spark, signal, n=60).withColumn("group_trend", F.col("group_trend") * F.when(F.col("symbol") < "S030", 2).otherwise(1))
    weights = research.weight_grid(spark, 0.5)
    a, b = (f(df, weights).orderBy("session_date", "candidate_id").toPandas() for f in (research.grid_daily, research.grid_daily_kernel))
    assert len(a) == len(b) == 60
    for c in ("rank_ic", "top_bottom_spread", "turnover"):
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=1e-9, equal_nan=True)


def test_walk_forward(spark):
    rows = [(dt.date(2025, 1, 3) + dt.timedelta(weeks=w), c, dt.datetime(2025, 1, 31) + dt.timedelta(weeks=w), 0.1 if c == 1 else 0.05, 0.01, 0.2, 100) for w in range(92) for c in range(2)]
    daily = spark.createDataFrame(rows, "session_date date, candidate_id int, label_end timestamp, rank_ic double, top_bottom_spread double, turnover double, n long")
    weights = spark.createDataFrame([(c, *[0.2] * 5) for c in range(2)], "candidate_id int, " + ", ".join(f"w_{g} double" for g in config.GROUPS))
    schedule = research.fold_schedule(daily)
    assert schedule.count() == 3  # the last, partial window is dropped
    folds = research.walk_forward(daily, weights).orderBy("fold").collect()
    # four weeks of embargo leave the first slot 48 training dates
    assert [(r["fold"], r["train_dates"], r["candidate_id"]) for r in folds] == [(0, 61, 1), (1, 74, 1)]
    assert folds[0]["test_start"] == dt.date(2025, 1, 3) + dt.timedelta(weeks=65)
    assert folds[0]["test_mean_turnover"] == pytest.approx(0.2) and folds[0]["train_objective"] == pytest.approx(0.1 - 0.05 * 0.2)


def test_baselines(spark):
    folds = spark.createDataFrame([(0, dt.date(2025, 1, 1), dt.date(2025, 12, 31))], "fold long, test_start date, test_end date")
    got = research.baseline_summary(research.baseline_comparison(panel_of(spark), folds, research.baseline_weights(spark))).collect()
    assert len(got) == 6 and all(r["mean_rank_ic"] > 0.99 and r["positive_ic_fold_rate"] == 1 for r in got)


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(source)
    for i, part in enumerate(events.orderBy("ts").randomSplit([1.0, 1.0], 5)):
        part.write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = ticks.bars_of_ticks(ticks.event_ticks(stream), late="60 days").writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = spark.table("bars").collect(), ticks.bars_of_ticks(ticks.event_ticks(events)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 10 and "return_20d" in df.columns
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 55
