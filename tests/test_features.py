"""Features against pandas, and their stated properties."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosscut import config
from crosscut.plans import features, panel

N = 320


def frame(symbol, phase=0.0, n=N, flat=False):
    i = np.arange(n)
    close = np.full(n, 50.0) if flat else 100 + 0.08 * i + 2 * np.sin(i / 9 + phase)
    open_ = close * (1 + 0.001 * np.sin(i / 5))
    return pd.DataFrame({"timestamp": [dt.datetime(2025, 1, 1) + dt.timedelta(days=int(k)) for k in i], "symbol": symbol, "open": open_, "high": np.maximum(open_, close) + 1, "low": np.minimum(open_, close) - 1, "close": close, "volume": 1e6 + 5e4 * np.cos(i / 11)})


@pytest.fixture(scope="module")
def built(spark):
    pdf = pd.concat([frame("A"), frame("B", 1.0), frame("FLAT", flat=True), frame("ONE", n=1)])
    bars = spark.createDataFrame(pdf)
    refs = frame("R", 0.3)
    bench = spark.createDataFrame(pd.DataFrame({"timestamp": refs.timestamp, "spy": refs.close, "qqq": refs.close * 3, "tlt": frame("x", 0.7).close, "gld": 100.0, "schd": refs.close}).drop(index=300))
    sectors = spark.createDataFrame(pd.DataFrame({"timestamp": refs.timestamp, "sector": "S", "sector_close": frame("A").close * 3}))
    universe = spark.createDataFrame([(s, "S") for s in ("A", "B", "FLAT", "ONE")], "symbol string, sector string")
    out = {m: features.feature_frame(bars, universe, bench, sectors, method=m).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True) for m in ("closed", "kernel")}
    return pdf, refs, out


def of(out, symbol):
    return out[out.symbol == symbol].reset_index(drop=True)


@pytest.mark.parametrize("method", ["closed", "kernel"])
def test_core_against_pandas(built, method):
    pdf, _, out = built
    for symbol in ("A", "B"):
        d, got = pdf[pdf.symbol == symbol].reset_index(drop=True), of(out[method], symbol)
        r, prev = d.close.pct_change(), d.close.shift()
        move = d.close.diff()
        ewm = lambda s, **k: s.ewm(adjust=False, **k).mean()
        gain, loss = ewm(move.clip(lower=0), alpha=1 / 14, min_periods=14), ewm(-move.clip(upper=0), alpha=1 / 14, min_periods=14)
        tr = pd.concat([d.high - d.low, (d.high - prev).abs(), (d.low - prev).abs()], axis=1).max(axis=1)
        want = {f"return_{n}d": d.close.pct_change(n) for n in config.RETURN_WINDOWS} | {f"ema_{n}": ewm(d.close, span=n, min_periods=n) for n in config.EMA_SPANS}
        want |= {f"price_to_ema_{n}": d.close / want[f"ema_{n}"] - 1 for n in config.EMA_SPANS} | {"ema_9_to_21": want["ema_9"] / want["ema_21"] - 1, "rsi_14": 100 - 100 / (1 + gain / loss)}
        want |= {f"volatility_{n}d": r.rolling(n).std() * math.sqrt(252) for n in (20, 60)} | {f"downside_volatility_{n}d": (r.clip(upper=0) ** 2).rolling(n).mean() ** 0.5 * math.sqrt(252) for n in (20, 60)}
        want |= {"current_drawdown_60d": d.close / d.close.rolling(60).max() - 1, "atr_14": tr.rolling(14).mean(), "atr_pct_14": tr.rolling(14).mean() / d.close}
        want |= {"median_dollar_volume_20d": (d.close * d.volume).rolling(20).median(), "relative_volume_20d": d.volume / d.volume.rolling(20).mean()}
        for name, x in want.items():
            np.testing.assert_allclose(got[name].to_numpy(float), x.to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=f"{symbol} {name}")


def test_relative_against_pandas(built):
    pdf, refs, out = built
    d, got = pdf[pdf.symbol == "B"].reset_index(drop=True), of(out["closed"], "B")
    spy = refs.close.copy()
    spy[300] = np.nan
    r, b = d.close.pct_change(fill_method=None), spy.pct_change(fill_method=None)
    want = {"corr_spy_60d": r.rolling(60).corr(b), "excess_return_spy_20d": d.close.pct_change(20) - spy.pct_change(20, fill_method=None)}
    r2 = r.where(b.notna())
    want["beta_spy_60d"] = (r2.rolling(60).cov(b) / b.rolling(60).var()).replace([np.inf, -np.inf], np.nan)
    for name, x in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), x.to_numpy(), rtol=1e-8, atol=1e-8, equal_nan=True, err_msg=name)


def test_properties(built):
    _, _, out = built
    a, flat, one = of(out["closed"], "A"), of(out["closed"], "FLAT"), of(out["closed"], "ONE")
    assert len(config.FEATURES) == len(set(config.FEATURES)) == 37
    np.testing.assert_allclose(a.corr_sector_60d.dropna(), 1, atol=1e-9)  # the same path at another scale
    np.testing.assert_allclose(a.excess_return_sector_20d.dropna(), 0, atol=1e-12)
    assert a.rsi_14.dropna().between(0, 100).all() and (a.current_drawdown_60d.dropna() <= 1e-12).all() and (a.atr_14.dropna() > 0).all()
    assert flat.rsi_14.isna().all() and flat.corr_spy_60d.isna().all() and (flat.volatility_20d.dropna() == 0).all()
    assert a.corr_gld_60d.isna().all()  # a flat benchmark
    assert np.isnan(a.corr_spy_60d.iloc[300]) and a.iloc[299][["corr_spy_60d"]].notna().all()
    assert len(one) == 1 and one[list(config.FEATURES)].isna().all(axis=None)
    first = {"return_20d": 20, "ema_9": 8, "ema_200": 199, "rsi_14": 14, "volatility_20d": 20, "current_drawdown_60d": 59, "atr_14": 13, "corr_qqq_60d": 60, "relative_volume_20d": 19}
    assert {k: int(a[k].first_valid_index()) for k in first} == first


def test_rising_prices_have_full_strength(spark):
    up = spark.createDataFrame(frame("U").assign(close=lambda d: 100.0 + np.arange(N)))
    got = features.core_features(up, method="closed").select("rsi_14").dropna().distinct().collect()
    assert [r[0] for r in got] == [100.0]


def test_labels_and_weeks(spark):
    df = spark.createDataFrame(frame("A", n=30))
    rows = panel.forward_labels(df, (5,)).orderBy("timestamp").collect()
    assert rows[0]["forward_return_5d"] == pytest.approx(rows[5]["close"] / rows[0]["close"] - 1) and rows[0]["forward_end_5d"] == rows[5]["timestamp"]
    assert rows[-1]["forward_return_5d"] is None
    days = spark.range(60).select((F.lit("2025-01-01").cast("date") + F.col("id").cast("int")).alias("timestamp"))
    got = days.select("timestamp", panel.week_end().alias("w")).collect()
    assert all(r["w"] == pd.Period(r["timestamp"], "W-FRI").end_time.date() for r in got)
    sampled = panel.weekly(df).orderBy("session_date").collect()
    assert [r["session_date"].weekday() for r in sampled[:-1]] == [4] * (len(sampled) - 1)


def test_unknown_sector(spark):
    u = spark.createDataFrame([("A", "S")], "symbol string, sector string")
    assert features.require_known_sectors(u, u.select("sector")).count() == 1
    with pytest.raises(ValueError, match="no benchmark"):
        features.require_known_sectors(u, u.select("sector").filter("false"))
