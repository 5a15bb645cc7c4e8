"""Bars, quarantine, eligibility, universe, manifests, hashes, files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crosscut.functions.hashing import canonical_json, json_hash, table_hash, whole_hash
from crosscut.operators import audit, manifests, normalize
from crosscut.sources.files import Catalog, read_bars_csv, read_payloads, read_text_table, write_table
from crosscut.sources.providers import PayloadProvider, StaticBarProvider, StaticUniverseProvider

BAR = "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double"


def day(i):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=i)


def bars(spark, n=260, symbol="AAA", price=100.0, volume=200_000.0):
    return spark.createDataFrame([(day(i), symbol, price, price + 1, price - 1, price, volume) for i in range(n)], BAR)


def test_normalize_vendor_rows(spark):
    raw = spark.createDataFrame(
        [("2025-01-02", " aaa ", "1", "2", "0.5", "1.5", "10", 0), ("2025-01-02", "AAA", "1", "3", "0.5", "1.7", "11", 1), ("2025-01-03", "AAA", "x", "3", "0.5", "1.7", "11", 2),
         ("2025-01-04", "AAA", "1", "1", "2", "1", "5", 3), ("2025-01-05", "AAA", "1", "2", "0.5", "1", "-5", 4), ("2025-01-06", "AAA", "NaN", "2", "1", "1", "5", 5)],
        "`Date` string, Symbol string, Open string, High string, Low string, Close string, Volume string, seq int")
    got = {str(r["timestamp"].date()): r for r in normalize.normalize_bars(raw).collect()}
    assert set(got) == {"2025-01-02", "2025-01-04", "2025-01-05"}
    assert got["2025-01-02"]["close"] == 1.7 and got["2025-01-02"]["symbol"] == "AAA" and got["2025-01-02"]["violations"] == []
    assert got["2025-01-04"]["violations"] == ["ohlc"] and got["2025-01-05"]["violations"] == ["negative_volume"]
    with pytest.raises(ValueError, match="invariants"):
        normalize.strict(normalize.normalize_bars(raw))
    with pytest.raises(ValueError, match="no bars"):
        normalize.strict(normalize.normalize_bars(raw.filter("false")))
    with pytest.raises(ValueError, match="missing columns: close"):
        normalize.normalize_bars(raw.drop("Close"))


@pytest.mark.parametrize(("bad_day", "states"), [("2020-10-21", {"quarantined": 1, "kept": 1}), ("2020-10-22", {"rejected": 2})])
def test_quarantine(spark, bad_day, states):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(bad_day), "A", 1.0, 0.5, 0.4, 1.0, 1.0), (dt.datetime(2020, 11, 1), "A", 1.0, 2.0, 0.5, 1.0, 1.0)], BAR)
    assert {r["state"]: r["count"] for r in normalize.quarantine(df).groupBy("state").count().collect()} == states


def test_quarantine_drops_good_rows_of_approved_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 10, 21), "A", 1.0, 0.5, 0.4, 1.0, 1.0), (dt.datetime(2023, 1, 24), "A", 1.0, 2.0, 0.5, 1.0, 1.0), (dt.datetime(2023, 1, 24), "B", 1.0, 2.0, 0.5, 1.0, 1.0)], BAR)
    got = {(r["symbol"], r["timestamp"].year): r["state"] for r in normalize.quarantine(df).collect()}
    assert got == {("A", 2020): "quarantined", ("A", 2023): "dropped", ("B", 2023): "kept"}


@pytest.mark.parametrize(("kw", "reasons"), [({}, []), ({"n": 100}, ["insufficient_history"]), ({"volume": 1000.0}, ["insufficient_dollar_volume"]), ({"price": 4.0}, ["price_below_minimum", "insufficient_dollar_volume"])])
def test_eligibility(spark, kw, reasons):
    row = normalize.eligibility(bars(spark, **kw)).first()
    assert row["reasons"] == reasons and row["eligible"] == (not reasons)


@pytest.mark.parametrize(("bounded", "full", "mode", "rows"), [(300, 2200, "bounded", 300), (1, 2200, "unbounded_fallback_trimmed", 366), (7, 7, "bounded_shorter_or_equal_fallback", 7)])
def test_history_resolution(spark, bounded, full, mode, rows):
    got = normalize.resolve_history(bars(spark, bounded), bars(spark, full), "2025-01-01", "2026-01-01", 252).groupBy("mode").count().collect()
    assert [(r["mode"], r["count"]) for r in got] == [(mode, rows)]


def test_payloads(spark, tmp_path):
    candle = {"datetime": 1735776000000, "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": 10}
    for name, empty, candles in (("A-B", False, [candle, candle | {"datetime": 1735862400000}]), ("E", True, [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"symbol": name, "empty": empty, "candles": candles}))
    got = PayloadProvider(spark, str(tmp_path)).history("A-B", "a.b").collect()
    assert [(r["symbol"], str(r["timestamp"].date())) for r in got] == [("A.B", "2025-01-02"), ("A.B", "2025-01-03")]
    with pytest.raises(ValueError, match="empty"):
        PayloadProvider(spark, str(tmp_path)).history("E", "E")
    assert read_payloads(spark, str(tmp_path)).count() == 2


def test_symbols_and_universe(spark):
    df = spark.createDataFrame([("brk.b ", "BRK-B", "X"), ("MSFT", "MSFT", "X")], "symbol string, provider_symbol string, sector string")
    assert [tuple(r) for r in df.select(normalize.provider_symbol(F.col("symbol"), "-"), normalize.provider_symbol(F.col("symbol"), "/")).collect()] == [("BRK-B", "BRK/B"), ("MSFT", "MSFT")]
    assert normalize.universe(df).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        normalize.universe(df.unionAll(df))
    assert normalize.universe_report(df).first()["mapped"] == 1
    assert StaticUniverseProvider(spark, [("A", "A", "n", None, None, "s")]).load().count() == 1
    assert StaticBarProvider({"A": bars(spark, 3)}).history("A", " b ").first()["symbol"] == "B"
    with pytest.raises(KeyError):
        StaticBarProvider({}).history("A", "A")


def test_manifest(spark):
    good, bad = normalize.violations(bars(spark)), normalize.violations(bars(spark, symbol="BAD")).withColumn("high", F.lit(1.0))
    df = good.unionByName(normalize.violations(bad.drop("violations")))
    names = spark.createDataFrame([("AAA",), ("BAD",), ("GONE",)], "symbol string")
    m = manifests.ingest_manifest(names, df)
    got = {r["symbol"]: (r["status"], r["reasons"]) for r in m.collect()}
    assert got == {"AAA": ("ok", []), "BAD": ("error", ["market_data_error"]), "GONE": ("error", ["market_data_error"])}
    with pytest.raises(ValueError, match="2 failed"):
        manifests.require_complete(m, 3)
    merged = manifests.merge_retry(m, m.filter("symbol = 'BAD'").withColumns({"status": F.lit("ok"), "attempt": F.lit(2)}))
    assert merged.count() == 3 and merged.filter("attempt = 2").count() == 1
    assert {r["reason"]: r["symbols"] for r in manifests.reason_histogram(m).collect()} == {"market_data_error": 2}


def test_error_families(spark):
    said = ["Invalid OHLC relationships for X", "HTTP 429", "HTTP 503", "HTTP 404", "no candles", "odd: thing", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, e string").orderBy("i").select(manifests.error_family(F.col("e"))).collect()]
    assert got == ["invalid_ohlc", "http_429_rate_limit", "http_5xx", "http_4xx", "empty_history", "odd", "unknown", "unknown"]


def test_hashes_ignore_order(spark):
    df = bars(spark, 20)
    flipped = df.select(*reversed(df.columns)).orderBy(F.desc("timestamp")).repartition(3)
    assert table_hash(df, ["symbol"]).first() == table_hash(flipped, ["symbol"]).first()
    assert whole_hash(df).first() == whole_hash(flipped).first() != whole_hash(df.limit(19)).first()
    assert canonical_json({"b": 2, "a": 1}) == canonical_json({"a": 1, "b": 2}) and len(json_hash({})) == 64


def test_files_and_catalog(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "na.csv").write_text("Date,Symbol,Note\n2025-01-02,NA,\n")
    row = read_text_table(spark, str(tmp_path / "a")).first()
    assert row["Symbol"] == "NA" and row["Note"] == ""
    assert read_bars_csv(spark, str(tmp_path / "a")).first()["symbol"] == "NA"
    (tmp_path / "a" / "two.csv").write_text("Date,Symbol,Note\n2025-01-02,A,\n2025-01-02,B,\n")
    with pytest.raises(ValueError, match="several symbols"):
        read_bars_csv(spark, str(tmp_path / "a"))
    write_table(bars(spark, 3), str(tmp_path / "out"), partition_by=["symbol"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    catalog = Catalog({"one": "/x/one/"})
    assert catalog["one"].bars == "/x/one/bars"
    with pytest.raises(ValueError, match="unknown data source"):
        catalog["two"]


@pytest.mark.parametrize(("change", "kind"), [({}, "clean"), ({2: 1.05}, "isolated_vendor_difference"), ({i: 0.95 for i in range(200)}, "persistent_adjustment_basis"), ({i: 1.01 for i in range(9)}, "localized_adjustment_window")])
def test_providers(spark, change, kind):
    a = bars(spark, 200)
    b = spark.createDataFrame([(r["timestamp"] + dt.timedelta(hours=4), r["symbol"], r["open"], r["high"], r["low"], r["close"] * change.get(i, 1.0), r["volume"]) for i, r in enumerate(sorted(a.collect()))], BAR)
    row = audit.compare_providers(a, b).first()
    assert row["classification"] == kind and row["max_offset_hours"] == 4 and row["volume_match_rate"] == 1
    assert row["status"] == ("ok" if kind == "clean" else "review")
    if len(change) == 1:
        assert row["worst_session"] == day(2).date()


def test_providers_without_overlap(spark):
    a, b = bars(spark, 3), bars(spark, 3).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 100 DAYS"))
    assert audit.compare_providers(a, b).first()["classification"] == "no_overlap"
    assert audit.compare_providers(a, b.filter("false")).first()["classification"] == "missing_source"
    with pytest.raises(ValueError, match="several rows"):
        audit.require_unique_sessions(a.unionAll(a))
