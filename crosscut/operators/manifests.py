"""Manifests: what became of every symbol of a universe, and audits of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import table_hash, whole_hash
from .normalize import eligibility, resolve_history


def ingest_manifest(securities: DataFrame, bars: DataFrame, **policy) -> DataFrame:
    """A row per security: status ok or error (no bars, or a violation), eligibility, rows and data hash."""
    broken = bars.groupBy("symbol").agg(F.max(F.size("violations")).alias("__broken"))
    hashes = table_hash(bars.drop("violations"), ["symbol"]).drop("rows")
    facts = eligibility(bars, **policy).join(broken, "symbol").join(hashes, "symbol")
    df = securities.select("symbol").join(facts, "symbol", "left")
    failed = F.col("rows").isNull() | (F.col("__broken") > 0)
    return df.select(
        "symbol", F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, F.lit(0)).otherwise(F.col("rows")).cast("long").alias("rows"),
        F.when(failed, False).otherwise(F.col("eligible")).alias("eligible"),
        F.when(failed, F.array(F.lit("market_data_error"))).otherwise(F.col("reasons")).alias("reasons"), F.when(~failed, F.col("data_hash")).alias("data_hash"),
    )


def with_manifest_hash(manifest: DataFrame) -> DataFrame:
    """manifest with its own hash (of all rows, in any order) on every row."""
    return manifest.crossJoin(F.broadcast(whole_hash(manifest).select(F.col("table_hash").alias("manifest_hash"))))  # one row


def history_manifest(securities: DataFrame, bounded: DataFrame, full: DataFrame, start: str, end: str, enough: int, **policy) -> DataFrame:
    """ingest_manifest over the history that resolve_history chooses, with the mode of each symbol's choice.

    enough is the least length of a bounded history; bounded and full are bars with violations; symbols without bars have no mode."""
    chosen = resolve_history(bounded, full, start, end, enough)
    modes = chosen.groupBy("symbol").agg(F.first("mode").alias("mode"))
    return ingest_manifest(securities, chosen.select(*bounded.columns), **policy).join(modes, "symbol", "left")


def reference_manifest(symbols: DataFrame, bars: DataFrame, *, fail_fast: bool = False) -> DataFrame:
    """A row per reference symbol: status, error, rows, first and last session, data hash of its bars (with violations).

    A symbol without bars or with a broken bar is an error row of its own; with fail_fast it raises instead."""
    facts = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("violations") > 0).alias("__broken"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )
    hashes = table_hash(bars.drop("violations"), ["symbol"]).drop("rows")
    df = symbols.select("symbol").distinct().join(facts, "symbol", "left").join(hashes, "symbol", "left")
    error = F.when(F.col("rows").isNull(), "empty price history").when(F.col("__broken") > 0, "Invalid OHLC relationships")
    df = df.select("symbol", F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"), F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last", F.when(error.isNull(), F.col("data_hash")).alias("data_hash"))
    if fail_fast and (bad := df.filter("status = 'error'").orderBy("symbol").first()):
        raise ValueError(f"{bad['symbol']}: {bad['error']}")
    return df


def eligible_bars(bars: DataFrame, manifest: DataFrame) -> DataFrame:
    """Bars of the symbols that the manifest has as ok and eligible: what features are built from."""
    return bars.join(manifest.filter((F.col("status") == "ok") & F.col("eligible")).select("symbol"), "symbol", "left_semi")


def merge_retry(old: DataFrame, retried: DataFrame) -> DataFrame:
    """old without the retried symbols, and the retried rows; columns that one side lacks are null."""
    return old.join(retried.select("symbol").distinct(), "symbol", "left_anti").unionByName(retried, allowMissingColumns=True)


def audit_manifest(manifest: DataFrame) -> DataFrame:
    """One row of counts."""
    ok = F.col("status") == "ok"
    return manifest.agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.col("eligible")).alias("eligible"), F.count_if(ok & ~F.col("eligible")).alias("ineligible"),
        F.min(F.when(ok, F.col("rows"))).alias("min_rows"), F.median(F.when(ok, F.col("rows"))).alias("median_rows"), F.max(F.when(ok, F.col("rows"))).alias("max_rows"),
    )


def require_complete(manifest: DataFrame, expected: int) -> DataFrame:
    """The audit row; raises when symbols are missing or failed."""
    audit = audit_manifest(manifest)
    row = audit.first()
    if row["symbols"] != expected or row["failed"]:
        raise ValueError(f"{row['symbols']} of {expected} symbols, {row['failed']} failed")
    return audit


def reason_histogram(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("symbols"))


def error_family(error: Column) -> Column:
    """The family of an error message. The strings tested for, and the names, are fixed values."""
    named = (
        F.when(error.contains("Invalid OHLC relationships"), "invalid_ohlc")
        .when(error.contains("HTTP 429"), "http_429_rate_limit")
        .when(error.contains("HTTP 5"), "http_5xx")
        .when(error.contains("HTTP 4"), "http_4xx")
        .when(error.contains("empty price history") | error.contains("no candles"), "empty_history")
    )
    return named.when(F.coalesce(error, F.lit("")) == "", "unknown").otherwise(F.split_part(error, F.lit(":"), F.lit(1)))


def invalid_dates(bars: DataFrame) -> DataFrame:
    """(session_date, bars, symbols): how many broken bars a session has, from bars with violations."""
    broken = bars.filter(F.size("violations") > 0)
    return broken.groupBy(F.to_date("timestamp").alias("session_date")).agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol").alias("symbols"))
