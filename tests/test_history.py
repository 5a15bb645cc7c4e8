"""Features and panels from histories against the same by windows over (symbol, timestamp) rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosscut import config
from crosscut.operators import crosssection
from crosscut.plans import features, history, panel, research
from crosscut.queries import registry
from crosscut.sources import tables


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Order tables of 60 suppliers; one starts late, one pauses for 80 sessions, one ships at a single price."""
    folder, rng = tmp_path_factory.mktemp("shop"), np.random.default_rng(5)
    days = [dt.datetime(1997, 1, 1) + dt.timedelta(days=i) for i in range(420) if (1 + i) % 7 > 1]
    rows = []
    for s in range(1, 61):
        for i, d in enumerate(days):
            if (rng.random() < 0.4 or s == 1) and not (s == 2 and i < 250) and not (s == 3 and 100 < i < 180):
                for n in range(1, 1 + int(rng.integers(1, 3))):
                    rows.append((len(rows) // 2, n, int(rng.integers(1, 9)), s, 700.0 if s == 4 else float(rng.uniform(900, 2000)), float(rng.integers(1, 50)), d))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(s, f"Supplier {s}", s % 3) for s in range(1, 61)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(i, f"R{i}") for i in range(2)], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def by_windows(spark, shop):
    bars, universe = tables.bars(spark, shop), tables.securities(spark, shop)
    return registry.by_session(features.feature_frame(bars, universe, tables.benchmarks(bars), tables.sector_benchmarks(bars, universe))).cache()


def same(got: pd.DataFrame, want: pd.DataFrame, keys: list[str], columns):
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and (got[keys] == want[keys]).all(axis=None)
    for c in columns:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-7, atol=1e-9, equal_nan=True, err_msg=c)


def test_all_features_as_by_windows(spark, shop, by_windows):
    got = registry.features(spark, shop)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # no dense row is shuffled
    same(got.toPandas(), by_windows.toPandas(), ["symbol", "session_date"], config.FEATURES)


def test_last_rows_and_counts_as_by_windows(spark, shop, by_windows):
    last = registry.by_session(features.latest_rows(by_windows.drop("session_date")))
    same(registry.features(spark, shop, last=True).toPandas(), last.toPandas(), ["symbol", "session_date"], config.FEATURES)
    want = by_windows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), *[F.count(f).alias(f"n_{f}") for f in config.FEATURES])
    got = registry.QUERIES["feature_manifest"](spark, shop)
    same(got.toPandas(), want.toPandas(), ["symbol"], ["rows", *[f"n_{f}" for f in config.FEATURES]])


def test_histories_over_batches(spark):
    """A key's rows in many batches make one history; keys without lines make none, keys without a mark are unknown."""
    lines = spark.createDataFrame([(k, d, 1, 1, 1, float(10 * k + d), 2.0) for k in (1, 2, 4) for d in range(5)] + [(None, 1, 1, 1, 1, 1.0, 1.0), (1, None, 1, 1, 1, 1.0, 1.0)], "key long, day int, a long, b long, c long, price double, quantity double")
    universe = spark.createDataFrame([(1, "X"), (2, None), (3, "Y")], "key long, sector string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        table = history.histories(lines, universe).toPandas().sort_values("number")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert table[["symbol", "known"]].values.tolist() == [["S00001", True], ["S00002", True], ["S00004", False]] and table["sector"].tolist() == ["X", None, None]
    assert [np.frombuffer(bytes(b)[20:60]).tolist() for b in table["bars"]] == [[10.0 * k + d for d in range(5)] for k in (1, 2, 4)]
    days = np.arange(5, dtype=np.int32)
    market = history.Market(days, {x: np.ones(5) for x in config.PORTFOLIO_REFERENCES}, {None: np.full(5, np.nan)})
    with pytest.raises(Exception, match="not in the universe: S00004"):
        history.feature_rows(history.histories(lines, universe), market, ["return_1d"]).collect()


@pytest.mark.parametrize("n", [2, 14, 20, 60])
def test_fold(n):
    x = np.random.default_rng(n).normal(size=(150, 3))
    x[70, 1] = np.nan
    for op, name in ((np.add, "sum"), (np.maximum, "max")):
        want = getattr(pd.DataFrame(x).rolling(n), name)()
        np.testing.assert_allclose(history.fold(x, n, op), want, rtol=1e-9, atol=1e-9, equal_nan=True)
    assert np.isnan(history.fold(x[:1], n)).all()


@pytest.mark.parametrize("sample", [10, 1000])
def test_panel_as_by_windows(spark, shop, by_windows, sample):
    """Bounds from tails (with thresholds of a small sample, some too narrow) and from all values."""
    table, market = tables.order_histories(spark, shop), tables.market(spark, shop)
    found = history.panel_bounds(table, market, config.SCORING_FEATURES, sample=sample)
    groups = [f"group_{g}" for g in config.GROUPS]
    wanted = [*groups, *[f"forward_{k}_{h}d" for k in ("return", "end") for h in config.HORIZONS]]
    got = history.panel_rows(table, market, found, wanted).toPandas()
    want = panel.scoring_panel(by_windows.drop("session_date")).toPandas()
    assert len(got) > 1000 and got["group_participation"].notna().any()
    same(got, want, ["symbol", "session_date"], [*groups, *[f"forward_return_{h}d" for h in config.HORIZONS]])
    order = lambda df: df.sort_values(["symbol", "session_date"]).reset_index(drop=True)
    assert (pd.to_datetime(order(got)["forward_end_20d"]).astype(str) == order(want)["forward_end_20d"].astype(str)).all()
    assert (order(got)["scoring_complete"] == order(want)["scoring_complete"]).all()


@pytest.mark.parametrize("ties", ["symbol", "stable"])
def test_by_dates_as_signal_metrics(spark, ties):
    """Ties, gaps, dates with too few rows between others, and spans of days."""
    rng = np.random.default_rng(3)
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(days=11 * d), f"S{s:02d}", float(np.round(rng.normal(), 1)), float(np.round(rng.normal(), 1)) if rng.random() < 0.95 else None) for d in range(20) for s in range(12 if d != 7 else 4)]
    df = spark.createDataFrame(rows, "session_date date, symbol string, v double, y double")
    want = crosssection.signal_metrics(df, "v", "y", ties=ties, min_n=6).toPandas()
    got = research.by_dates(df, "k int", lambda date, d: [((1,), d["v"].to_numpy(), d["y"].to_numpy())], ties=ties, min_n=6).toPandas()
    same(got, want, ["session_date"], ["n", "rank_ic", "top_bottom_spread", "turnover"])


def test_parity_of_histories_and_windows(spark, shop, monkeypatch):
    """The audit compares the queries' own features, all symbols and no table of dense bars; it finds a small fault."""
    monkeypatch.setattr(tables, "bars", None)
    want = {f: (60, 0) for f in config.FEATURES}
    assert {r[0]: (r[1], r[2]) for r in registry.QUERIES["feature_parity"](spark, shop).collect()} == want
    right = registry.features
    monkeypatch.setattr(registry, "features", lambda *a, **k: right(*a, **k).withColumns({"rsi_14": F.col("rsi_14") + 1e-6, "corr_gld_60d": F.when(F.col("symbol") != "S00007", F.col("corr_gld_60d"))}))
    got = {r[0]: (r[1], r[2]) for r in registry.QUERIES["feature_parity"](spark, shop).collect()}
    assert {f: x for f, x in got.items() if x != want[f]} == {"rsi_14": (60, 59), "corr_gld_60d": (60, 1)}  # one symbol never moves, and has no rsi_14


def test_last_averages_as_pandas(spark):
    """Runs, a first move in the second session, one session, a first close that is missing."""
    closes = {1: [5.0, 7.0, 7.0, 6.0, 6.0, 6.0, 9.0], 2: [3.0, 3.0, 3.0, 1.0, 1.0, 1.0, 1.0], 3: [np.nan] * 6 + [4.0], 4: [None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]}
    lines = [(k, d, 1, 1, 1, v, 1.0) for k, x in closes.items() for d, v in enumerate(x) if v is None or v == v]
    table = history.histories(spark.createDataFrame(lines, "key long, day int, a long, b long, c long, price double, quantity double"), spark.createDataFrame([(k, "X") for k in closes], "key long, sector string"))
    got = features.last_averages(history.close_runs(table, np.arange(7, dtype=np.int32))).toPandas().set_index("symbol")
    for k in (1, 2, 3):
        x = pd.Series(closes[k]).dropna().reset_index(drop=True)
        for n in config.EMA_SPANS:
            assert got.loc[f"S{k:05d}", f"e_{n}"] == pytest.approx(x.ewm(alpha=2 / (n + 1), adjust=False).mean().iloc[-1], rel=1e-12)
        for c, move in (("__g", x.diff()), ("__l", -x.diff())) if len(x) > 1 else ():
            assert got.loc[f"S{k:05d}", c] == pytest.approx(move.dropna().clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean().iloc[-1], rel=1e-12)
    assert got.loc["S00004"].isna().all()
