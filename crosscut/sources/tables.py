"""Bars, universe and benchmarks made from the driver's order tables: suppliers are securities, ship dates sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeseries import CLOSED_FORM_ROWS
from ..materialize import once, settled_and_released


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(key: str):
    """S and the key in five digits at least; lpad alone would cut longer keys."""
    text = F.col(key).cast("string")
    return F.concat(F.lit("S"), F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0"))).alias("symbol")


def symbol_number(symbol: str = "symbol"):
    """The key in a symbol, all its digits."""
    return F.substring(symbol, 2, 19).cast("long")


def sparse_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each day on which a supplier ships."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = F.col("l_extendedprice")
    return _read(spark, sf_dir, "lineitem").groupBy(_symbol("l_suppkey"), F.date_trunc("day", "l_shipdate").alias("timestamp")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for every supplier and session from its first shipment on: days without one repeat the close, volume 0."""
    bars = sparse_bars(spark, sf_dir)
    sessions = _read(spark, sf_dir, "lineitem").select(F.date_trunc("day", "l_shipdate").alias("timestamp")).distinct()
    calendar = sessions.agg(F.array_sort(F.collect_list("timestamp")).alias("days"))  # some thousand dates
    first = bars.groupBy("symbol").agg(F.min("timestamp").alias("first")).withColumn("one", F.lit(1))
    grid = first.join(F.broadcast(calendar.withColumn("one", F.lit(1))), "one").select("symbol", F.explode(F.filter("days", lambda d: d >= F.col("first"))).alias("timestamp"))
    df = grid.join(bars, ["symbol", "timestamp"], "left")
    carried = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("timestamp"))
    df = df.withColumn("carried", carried)
    return df.select("symbol", "timestamp", *[F.coalesce(c, "carried").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_bars, written once in an application: features, benchmarks and panels scan that."""
    return once(spark, "bars", [f"{sf_dir}/lineitem.parquet"], lambda: dense_bars(spark, sf_dir))


def ewm_method(spark: SparkSession, sf_dir: str) -> str:
    """Closed form where the calendar is short enough for it, by a scan of one column."""
    n = _read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct().count()
    return "closed" if n <= CLOSED_FORM_ROWS else "kernel"


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, provider_symbol, name, sector (the region of the supplier's nation)."""
    s, n, r = (_read(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    df = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.select(_symbol("s_suppkey"), _symbol("s_suppkey").alias("provider_symbol"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"))


def benchmarks(bars: DataFrame) -> DataFrame:
    """Mean closes by session: of all securities (spy) and of those whose number leaves 0 to 3 over fours."""
    rest = F.pmod(symbol_number(), F.lit(4))
    baskets = {x: F.when(rest == i, F.col("close")) for i, x in enumerate(("qqq", "tlt", "gld", "schd"))}
    return bars.groupBy("timestamp").agg(F.round(F.avg("close"), 4).alias("spy"), *[F.round(F.avg(c), 4).alias(x) for x, c in baskets.items()])


def sector_benchmarks(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return bars.join(universe.select("symbol", "sector"), "symbol").groupBy("timestamp", "sector").agg(F.round(F.avg("close"), 4).alias("sector_close"))


def sessions(spark: SparkSession, sf_dir: str) -> list[int]:
    """All days on which something ships, as days since 1970, ascending: some thousand."""
    days = _read(spark, sf_dir, "lineitem").select(F.unix_date(F.to_date("l_shipdate")).alias("d")).distinct().dropna().collect()
    return sorted(r["d"] for r in days)


def order_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plans.history.histories() of the order lines, written once in an application."""
    from ..plans.history import histories

    def make() -> DataFrame:
        lines = _read(spark, sf_dir, "lineitem").select(
            F.col("l_suppkey").cast("long").alias("key"), F.unix_date(F.to_date("l_shipdate")).alias("day"), F.col("l_orderkey").cast("long").alias("a"), F.col("l_linenumber").cast("long").alias("b"),
            F.col("l_partkey").cast("long").alias("c"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"),
        )
        return histories(lines, securities(spark, sf_dir).select(symbol_number().alias("key"), "sector"))

    return once(spark, "histories", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")], make, settled_and_released)


def market(spark: SparkSession, sf_dir: str):
    """plans.history.Market of the order tables; its closes are written once in an application."""
    import numpy as np

    from ..plans.history import market_closes, market_of

    days = np.array(sessions(spark, sf_dir), np.int32)
    closes = once(spark, "market", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")], lambda: market_closes(order_histories(spark, sf_dir), days))
    return market_of(closes, days)


def panel_bounds(spark: SparkSession, sf_dir: str, features):
    """plans.history.panel_bounds of the order tables, found once in an application."""
    from ..plans.history import panel_bounds as find

    return once(spark, "bounds " + " ".join(features), [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")], lambda: find(order_histories(spark, sf_dir), market(spark, sf_dir), features), keep=lambda x, _: x)
