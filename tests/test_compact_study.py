"""The compact-alpha study against pandas."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosscut import config
from crosscut.plans import research


def test_four_candidates_by_fold(spark):
    n, weeks = 60, 4
    rows = [(dt.date(2025, 1, 3) + dt.timedelta(weeks=w), f"S{i:03d}", (i * 37 + w) % 61 / 50, (i * 11 + w) % 59 / 100, None if i == 3 else (i * 7 + 2 * w) % 31 / 10, *[(i * 13 + w + h) % 53 / 40 for h in config.HORIZONS]) for w in range(weeks) for i in range(n)]
    names = ["session_date", "symbol", "return_252d", "return_20d", "ema_50_to_200", *[f"forward_return_{h}d" for h in config.HORIZONS]]
    df = spark.createDataFrame(rows, "session_date date, symbol string, " + ", ".join(f"{c} double" for c in names[2:]))
    folds = spark.createDataFrame([(0, rows[0][0], rows[n][0]), (1, rows[2 * n][0], rows[-1][0])], "fold long, test_start date, test_end date")
    study = research.compact_study(research.compact_candidates(df), folds)
    got = {(r["fold"], r["candidate"], r["horizon"]): r for r in study.collect()}
    p = pd.DataFrame(rows, columns=names)
    p["momentum"] = (1 + p.return_252d) / (1 + p.return_20d) - 1
    rank = lambda c: p.groupby("session_date")[c].transform(lambda x: x.round(9).rank(pct=True))
    p["return_252d"], p["momentum_252d_ex_20d"], p["ema_50_to_200"] = rank("return_252d"), rank("momentum"), rank("ema_50_to_200")
    p["momentum_12_1_plus_slow_trend"] = (p.momentum_252d_ex_20d + p.ema_50_to_200) / 2
    assert len(got) == 2 * 4 * len(config.HORIZONS)
    for (fold, name, h), r in got.items():
        own = p[p.session_date.isin([rows[2 * fold * n][0], rows[(2 * fold + 1) * n][0]])].dropna(subset=[name])
        ics = [x[name].round(9).rank().corr(x[f"forward_return_{h}d"].rank()) for _, x in own.groupby("session_date")]
        assert r["mean_rank_ic"] == pytest.approx(sum(ics) / 2) and r["dates"] == 2
    summary = research.compact_study_summary(study).filter(F.col("candidate") == "ema_50_to_200").collect()
    assert len(summary) == 3 and all(r["folds"] == 2 for r in summary)
