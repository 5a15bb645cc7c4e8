"""Securities and bars from the order tables."""

import datetime as dt

from crosscut.operators import normalize
from crosscut.queries import registry
from crosscut.sources import tables

KEYS = (7, 10_000, 10_001, 100_000, 100_001, 123_456)


def test_six_digit_keys_stay_apart(spark, tmp_path):
    day = dt.datetime(1998, 1, 5)
    spark.createDataFrame([(i, 1, 1, k, float(k), 1.0, day) for i, k in enumerate(KEYS)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"n{k}", 1) for k in KEYS], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, 1)], "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, "R")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    sf = str(tmp_path)
    want = {"S00007": 7.0, "S10000": 1e4, "S10001": 10_001.0, "S100000": 1e5, "S100001": 100_001.0, "S123456": 123_456.0}
    bars = tables.dense_bars(spark, sf)
    assert {r["symbol"]: r["close"] for r in bars.collect()} == want and bars.count() == len(KEYS)
    assert sorted(r["symbol"] for r in tables.securities(spark, sf).collect()) == sorted(want)
    assert {r["symbol"] for r in normalize.normalize_bars(registry.raw_rows(spark, sf)).collect()} == set(want)
    assert tables.benchmarks(bars).first()["qqq"] == round((10_000 + 100_000 + 123_456) / 3, 4)  # keys that fours divide
    changed = {r["symbol"] for r in registry.other_provider(bars).collect() if r["close"] != want[r["symbol"]]}
    assert changed == {"S10000", "S100000", "S100001"}  # tens, and an eleven
