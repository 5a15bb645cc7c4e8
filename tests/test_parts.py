"""Manifest hashes, reference ingest, payload quarantine, file hashes, typed scans, strict lookups and settled tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from crosscut import config
from crosscut.functions.hashing import file_hash, whole_hash
from crosscut.materialize import once
from crosscut.operators import manifests, normalize
from crosscut.plans import features, research
from crosscut.sources import files
from tests.test_normalize import bars, day


def test_manifest_hash_follows_content_alone(spark):
    one = spark.createDataFrame([("A", "ok", 1), ("B", "error", 0)], "symbol string, status string, rows int")
    hashes = lambda df: {r["manifest_hash"] for r in manifests.with_manifest_hash(df).collect()}
    assert hashes(one) == hashes(one.orderBy(F.desc("symbol")).select("rows", "status", "symbol")) and len(hashes(one)) == 1
    assert hashes(one) != hashes(one.withColumn("rows", F.col("rows") + 1))


def test_reference_manifest(spark):
    good, bad = bars(spark, 3, "GOOD"), bars(spark, 3, "BAD").withColumn("high", F.col("low") / 2)
    rows = normalize.violations(good.unionByName(bad))
    symbols = spark.createDataFrame([("GOOD",), ("BAD",), ("NONE",), ("GOOD",)], "symbol string")
    got = {r["symbol"]: (r["status"], r["error"], r["rows"]) for r in manifests.reference_manifest(symbols, rows).collect()}
    assert got == {"GOOD": ("ok", None, 3), "BAD": ("error", "Invalid OHLC relationships", 3), "NONE": ("error", "empty price history", 0)}
    with pytest.raises(ValueError, match="BAD"):
        manifests.reference_manifest(symbols, rows, fail_fast=True)


def payload(spark, date):
    start = int(dt.datetime.fromisoformat(f"{date}T00:00:00+00:00").timestamp() * 1000)
    candles = [(start, 10.0, 5.0, 9.0, 10.0, 1.0), (start + 86_400_000, 10.0, 11.0, 9.0, 10.0, 1.0)]
    return spark.createDataFrame([("AAA", False, candles)], files.PAYLOAD)


@pytest.mark.parametrize("date", config.QUARANTINE_DATES)
def test_payload_quarantine(spark, date):
    kept, out = normalize.quarantined_payloads(payload(spark, date))
    assert (kept.count(), out.count()) == (1, 1)


def test_payload_quarantine_refuses_other_dates(spark):
    with pytest.raises(Exception, match="not approved"):
        normalize.quarantined_payloads(payload(spark, "2023-06-06"))[0].collect()


def test_history_manifest(spark):
    full = normalize.violations(bars(spark, 300, "A").unionByName(bars(spark, 300, "B")))
    bounded = full.filter((F.col("symbol") == "A") | (F.col("timestamp") > F.lit(day(290)).cast("timestamp")))
    securities = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    got = {r["symbol"]: r for r in manifests.history_manifest(securities, bounded, full, "2025-01-01", "2025-07-31", 100).collect()}
    assert got["A"]["mode"] == "bounded" and got["A"]["rows"] == 300 and got["A"]["eligible"]
    assert got["B"]["mode"] == "unbounded_fallback_trimmed" and got["B"]["rows"] == 212 and got["B"]["reasons"] == ["insufficient_history"]
    assert got["C"]["status"] == "error" and got["C"]["mode"] is None


def test_invalid_dates_and_eligible_bars(spark):
    df = normalize.violations(bars(spark, 3, "A").unionByName(bars(spark, 3, "B")).withColumn("high", F.when(F.col("timestamp") == F.lit(day(1)).cast("timestamp"), F.col("low") / 2).otherwise(F.col("high"))))
    assert [(r["session_date"], r["bars"], r["symbols"]) for r in manifests.invalid_dates(df).collect()] == [(day(1).date(), 2, 2)]
    manifest = spark.createDataFrame([("A", "ok", True), ("B", "ok", False)], "symbol string, status string, eligible boolean")
    assert {r["symbol"] for r in manifests.eligible_bars(df, manifest).collect()} == {"A"}


def test_empty_symbols_fail(spark):
    df = spark.createDataFrame([(" ",)], "s string").select(normalize.provider_symbol(F.col("s"), "-"))
    with pytest.raises(Exception, match="empty symbol"):
        df.collect()


def test_features_refuse_symbols_out_of_the_universe(spark):
    df, sectors = bars(spark, 5), spark.createDataFrame([(day(0), "S", 1.0)], "timestamp timestamp, sector string, sector_close double")
    refs = spark.createDataFrame([(day(0), *[1.0] * 5)], "timestamp timestamp, " + ", ".join(f"{x} double" for x in config.PORTFOLIO_REFERENCES))
    universe = spark.createDataFrame([("BBB", "S")], "symbol string, sector string")
    with pytest.raises(Exception, match="not in the universe: AAA"):
        features.feature_frame(df, universe, refs, sectors, method="closed").collect()


def test_reference_symbols(spark):
    got = features.reference_symbols()
    assert got[:5] == ["SPY", "QQQ", "TLT", "GLD", "SCHD"] and len(got) == len(set(got)) == 16
    rows = features.with_benchmark_names(spark.createDataFrame([("Energy",), ("Other",), (None,)], "sector string")).collect()
    assert [r["sector_benchmark"] for r in rows] == ["XLE", None, None]


def test_files(spark, tmp_path):
    df = bars(spark, 3)
    assert files.write_table(df, str(tmp_path / "t")) == whole_hash(df).first()["table_hash"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("symbol,n\nA,1\nB,2\n")
    assert [tuple(r) for r in files.read_typed_csv(spark, str(tmp_path / "x"), "symbol string, n int").orderBy("symbol").collect()] == [("A", 1), ("B", 2)]
    row = file_hash(spark, str(tmp_path / "x")).first()
    assert row["sha256"] == hashlib.sha256(b"symbol,n\nA,1\nB,2\n").hexdigest() and row["length"] == 17
    (tmp_path / "x" / "a.csv").write_text("symbol,n\nA,one\n")
    with pytest.raises(Exception):
        files.read_typed_csv(spark, str(tmp_path / "x"), "symbol string, n int").collect()


def test_once_follows_its_inputs(spark, tmp_path):
    source, calls = str(tmp_path / "in"), []

    def make():
        calls.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    assert once(spark, "x", [source], make).count() == once(spark, "x", [source], make).count() == 3 and len(calls) == 1
    spark.range(5).write.mode("append").parquet(source)
    assert once(spark, "x", [source], make).count() == 8 and len(calls) == 2


def test_walk_forward_summary(spark):
    names = ["test_mean_rank_ic", "test_median_rank_ic", "test_mean_spread", "test_mean_turnover", "test_positive_spread_rate", "test_objective", *[f"w_{g}" for g in research.GROUP_NAMES]]
    row = research.walk_forward_summary(spark.createDataFrame([[float(i)] * len(names) for i in (1, 4)], names)).first()
    assert row["folds"] == 2 and all(row[n] == 2.5 for n in names)
