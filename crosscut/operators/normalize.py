"""Daily bars from vendor rows: names, types, invariants, quarantine, eligibility and history choice.

Row order carries no meaning in Spark: where the last of several rows counts, a column `seq` says which that is. A bad
symbol never fails a run: violations become rows (manifest mode); strict() raises for those who want that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

PRICES = ("open", "high", "low", "close")
BAR = ("timestamp", "symbol", *PRICES, "volume")


def canonical_names(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores; a date column becomes the timestamp where there is none."""
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return df.withColumnRenamed("date", "timestamp") if "timestamp" not in df.columns else df


def require(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def typed(df: DataFrame) -> DataFrame:
    """Bar columns with their types; text that is no number, and NaN, become null."""
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None).cast("double")).alias(c)
    extra = ["seq"] if "seq" in df.columns else []
    return df.select(F.expr("try_cast(`timestamp` AS timestamp)").alias("timestamp"), F.upper(F.trim("symbol")).alias("symbol"), *[number(c) for c in (*PRICES, "volume")], *extra)


def keep_last(df: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp"), seq: str = "seq") -> DataFrame:
    """The row with the greatest seq for each key, by an aggregate that combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def bad_prices() -> Column:
    """Low above or high below another price; false where a price is missing."""
    low, high = F.least("open", "close", "high"), F.greatest("open", "close", "low")
    full = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return F.coalesce(full & ((F.col("low") > low) | (F.col("high") < high)), F.lit(False))


def violations(df: DataFrame) -> DataFrame:
    """df with an array of the invariants that each row breaks."""
    return df.withColumn("violations", F.array_compact(F.array(F.when(bad_prices(), F.lit("ohlc")), F.when(F.col("volume") < 0, F.lit("negative_volume")))))


def normalize_bars(df: DataFrame) -> DataFrame:
    """Rows with all bar fields, the last of each (symbol, timestamp), with their violations."""
    df = typed(require(canonical_names(df), BAR)).dropna(subset=list(BAR))
    return violations(keep_last(df) if "seq" in df.columns else df)


def strict(bars: DataFrame) -> DataFrame:
    """bars without the violations column; raises where a row has one, or where there is no row."""
    worst = bars.agg(F.count(F.lit(1)), F.sum(F.when(F.size("violations") > 0, 1).otherwise(0))).first()
    if not worst[0]:
        raise ValueError("no bars")
    if worst[1]:
        raise ValueError(f"{worst[1]} rows break the bar invariants")
    return bars.drop("violations")


def quarantine(bars: DataFrame, dates: tuple[str, ...] = config.QUARANTINE_DATES) -> DataFrame:
    """bars with `state`: symbols with a bad row lose all rows of the approved dates ("quarantined" where bad, "dropped"
    where good); a bad row on another date rejects its symbol ("rejected")."""
    by = Window.partitionBy("symbol")
    approved = F.to_date("timestamp").isin(*[F.to_date(F.lit(d)) for d in dates])
    df = bars.withColumns({"__bad": bad_prices(), "__date": approved})
    df = df.withColumns({"__any": F.max("__bad").over(by), "__unknown": F.max(F.col("__bad") & ~F.col("__date")).over(by)})
    state = F.when(F.col("__unknown"), "rejected").when(F.col("__bad"), "quarantined").when(F.col("__any") & F.col("__date"), "dropped").otherwise("kept")
    return df.withColumn("state", state).drop("__bad", "__date", "__any", "__unknown")


def eligibility(bars: DataFrame, *, min_rows: int = config.MIN_HISTORY_ROWS, min_price: float = config.MIN_PRICE, min_dollar_volume: float = config.MIN_DOLLAR_VOLUME) -> DataFrame:
    """(symbol, rows, latest_close, median_dollar_volume, reasons, eligible). A short history is the only reason named."""
    back = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    last = bars.withColumn("__back", F.row_number().over(back))
    facts = last.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("close", "timestamp").alias("latest_close"),
        F.median(F.when(F.col("__back") <= 20, F.col("close") * F.col("volume"))).alias("median_dollar_volume"),
    )
    later = F.array_compact(F.array(F.when(F.col("latest_close") < min_price, F.lit("price_below_minimum")), F.when(F.col("median_dollar_volume") < min_dollar_volume, F.lit("insufficient_dollar_volume"))))
    facts = facts.withColumn("reasons", F.when(F.col("rows") < min_rows, F.array(F.lit("insufficient_history"))).otherwise(later))
    return facts.withColumn("eligible", F.size("reasons") == 0)


def resolve_history(bounded: DataFrame, full: DataFrame, start: str, end: str, min_rows: int) -> DataFrame:
    """The bounded history where it is long enough, else the full one cut to [start, end] where that is longer."""
    inside = full.filter(F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    n_b, n_f = bounded.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_b")), inside.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_f"))
    mode = n_b.join(n_f, "symbol", "full_outer").fillna(0).withColumn(
        "mode", F.when(F.col("n_b") >= min_rows, "bounded").when(F.col("n_f") > F.col("n_b"), "unbounded_fallback_trimmed").otherwise("bounded_shorter_or_equal_fallback")
    )
    trimmed = F.col("mode") == "unbounded_fallback_trimmed"
    return bounded.join(mode.filter(~trimmed), "symbol").unionByName(inside.join(mode.filter(trimmed), "symbol"))


def bars_of_payloads(payloads: DataFrame) -> DataFrame:
    """Bar rows of nested candle payloads (symbol, empty, candles of epoch milliseconds); empty ones give none."""
    flat = payloads.filter(~F.coalesce("empty", F.lit(False))).select(F.upper(F.trim("symbol")).alias("symbol"), F.posexplode("candles").alias("seq", "c"))
    return flat.select(F.timestamp_millis("c.datetime").alias("timestamp"), "symbol", *[F.col(f"c.{c}").cast("double").alias(c) for c in (*PRICES, "volume")], "seq")


def quarantined_payloads(payloads: DataFrame, dates: tuple[str, ...] = config.QUARANTINE_DATES) -> tuple[DataFrame, DataFrame]:
    """(bars, quarantined) of nested candle payloads: what quarantine() keeps, and the broken bars of approved dates.

    A broken bar on another date fails the run when rows are computed."""
    state = quarantine(normalize_bars(bars_of_payloads(payloads)), dates)
    refused = F.raise_error(F.concat(F.lit("broken bar on a date that is not approved: "), F.col("symbol")))
    state = state.withColumn("state", F.when(F.col("state") != "rejected", F.col("state")).otherwise(refused))
    return state.filter("state = 'kept'").drop("state"), state.filter("state = 'quarantined'").drop("state")


def provider_symbol(symbol: Column, separator: str) -> Column:
    """A vendor's spelling: class shares after a dash or a slash instead of a dot; an empty symbol fails the run."""
    symbol = F.when(F.trim(symbol) == "", F.raise_error(F.lit("empty symbol"))).otherwise(symbol)
    return F.replace(F.upper(F.trim(symbol)), F.lit("."), F.lit(separator))


def universe(securities: DataFrame) -> DataFrame:
    """Trimmed upper-case symbols; duplicates raise."""
    df = securities.withColumn("symbol", F.upper(F.trim("symbol")))
    if twice := [r["symbol"] for r in df.groupBy("symbol").count().filter("count > 1").orderBy("symbol").limit(5).collect()]:
        raise ValueError(f"duplicate symbols: {', '.join(twice)}")
    return df


def universe_report(securities: DataFrame) -> DataFrame:
    """Per sector: rows, duplicates, empty symbols, and symbols that a vendor spells otherwise."""
    df = securities.withColumn("symbol", F.upper(F.trim("symbol")))
    df = df.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return df.groupBy("sector").agg(
        F.count(F.lit(1)).alias("securities"), F.count_if(F.col("copies") > 1).alias("duplicates"),
        F.count_if(F.coalesce(F.col("symbol"), F.lit("")) == "").alias("empty_symbols"), F.count_if(F.col("symbol") != F.col("provider_symbol")).alias("mapped"),
    )
