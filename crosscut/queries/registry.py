"""Queries over the driver's tables, one for each operator of the engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import row_hash
from ..materialize import once, settled, settled_and_released
from ..operators import audit, crosssection, manifests, normalize
from ..plans import features as feature_plans
from ..plans import panel as panel_plans
from ..plans import history, research
from ..sources import tables
from ..streaming import ticks
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = ("symbol", "session_date")


def register(name: str, with_: str | None = None, select: str | None = None, **digits: int | None):
    """Register a query. digits names its columns: None as they are, else rounded so far in both engines."""

    def wrap(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(spark, sf_dir)
            return df.select(*[F.col(c) if d is None else (F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()])

        QUERIES[name] = run
        if select:
            columns = ", ".join(c if d is None else f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items())
            ORACLE_SQL[name] = f"{'WITH RECURSIVE ' + with_ if with_ else ''} SELECT {columns} FROM ({select})"
        return make

    return wrap


def columns(*names: str, digits: int | None = None, **more: int | None) -> dict:
    return dict.fromkeys(names, digits) | more


def by_session(df: DataFrame) -> DataFrame:
    return df.withColumn("session_date", F.to_date("timestamp"))


# ---------------------------------------------------------------- bars, quality, universe


@register("bars_from_ticks", sql.SPARSE, "SELECT *, CAST(ts AS DATE) AS session_date FROM sparse", **columns(*KEYS), **columns("open", "high", "low", "close", "volume", digits=2))
def _(spark, sf):
    return by_session(tables.sparse_bars(spark, sf))


@register("dense_bars", sql.DENSE, "SELECT *, CAST(ts AS DATE) AS session_date FROM dense", **columns(*KEYS), **columns("open", "high", "low", "close", "volume", digits=2))
def _(spark, sf):
    return by_session(tables.dense_bars(spark, sf))


@register("event_bars", None, """SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS session_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""", **columns(*KEYS), **columns("open", "high", "low", "close", "volume", digits=2))  # fmt: skip
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return by_session(ticks.bars_of_ticks(ticks.event_ticks(events)))


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a vendor would send them: text, several rows a session, some broken."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = lambda c: F.when(F.col("l_linenumber") == 7, "n/a").otherwise(c.cast("string"))
    price = F.col("l_extendedprice")
    return li.select(
        F.col("l_shipdate").cast("string").alias("Date"), F.concat(F.lit(" "), F.lower(tables._symbol("l_suppkey"))).alias("Symbol"), text(price).alias("Open"),
        (price * F.when(F.col("l_linenumber") == 6, 0.5).otherwise(1.5)).cast("string").alias("High"), (price * 0.5).cast("string").alias("Low"), price.cast("string").alias("Close"),
        F.when(F.col("l_linenumber") == 5, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("string").alias("Volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )


RAW = """raw AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) AS ts, 'S' || lpad(CAST(l_suppkey AS VARCHAR), greatest(5, CAST(length(CAST(l_suppkey AS VARCHAR)) AS INTEGER)), '0') AS symbol, l_extendedprice AS open,
         l_extendedprice * CASE WHEN l_linenumber = 6 THEN 0.5 ELSE 1.5 END AS high, l_extendedprice * 0.5 AS low, l_extendedprice AS close,
         CASE WHEN l_linenumber = 5 THEN -l_quantity ELSE l_quantity END AS volume, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq
  FROM lineitem WHERE l_linenumber <> 7
), bars AS (SELECT *, CAST(ts AS DATE) AS session_date, high < greatest(open, close, low) AS bad FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) = 1)"""


@register("normalize_bars", RAW, "SELECT *, concat_ws('|', CASE WHEN bad THEN 'ohlc' END, CASE WHEN volume < 0 THEN 'negative_volume' END) AS violations FROM bars",
          **columns(*KEYS, "violations"), **columns("open", "high", "low", "close", "volume", digits=3))
def _(spark, sf):
    df = by_session(normalize.normalize_bars(raw_rows(spark, sf)))
    return df.withColumn("violations", F.array_join("violations", "|"))


@register("dedupe_keep_last", RAW, "SELECT symbol, count(*) AS rows, sum(close) AS total FROM bars GROUP BY symbol", **columns("symbol", "rows", total=2))
def _(spark, sf):
    df = normalize.keep_last(normalize.typed(normalize.canonical_names(raw_rows(spark, sf))).dropna(subset=list(normalize.BAR)))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("total"))


@register("ohlc_violations", RAW, "SELECT symbol, session_date, volume FROM bars WHERE bad OR volume < 0", **columns(*KEYS), volume=2)
def _(spark, sf):
    return by_session(normalize.normalize_bars(raw_rows(spark, sf)).filter(F.size("violations") > 0))


QUARANTINE = ("1996-05-01", "1997-05-01", "1998-05-01")
Q_SQL = f"{RAW}, q AS (SELECT *, max(bad) OVER (PARTITION BY symbol) AS anyb, CAST(session_date AS VARCHAR) IN {QUARANTINE} AS ok, max(bad AND CAST(session_date AS VARCHAR) NOT IN {QUARANTINE}) OVER (PARTITION BY symbol) AS unknown FROM bars)"


@register("quarantine_sessions", Q_SQL, "SELECT symbol, CASE WHEN unknown THEN 'rejected' WHEN bad THEN 'quarantined' WHEN anyb AND ok THEN 'dropped' ELSE 'kept' END AS state, count(*) AS rows FROM q GROUP BY ALL", **columns("symbol", "state", "rows"))
def _(spark, sf):
    bars = normalize.normalize_bars(raw_rows(spark, sf))
    return normalize.quarantine(bars, QUARANTINE).groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("rows"))


@register("history_resolution", f"""{sql.SPARSE}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM sparse),
  bounded AS (SELECT * FROM b WHERE back <= 300 AND ts >= TIMESTAMP '2000-06-01'), inside AS (SELECT * FROM sparse WHERE ts BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2001-06-30'),
  n AS (SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(nb, 0) AS nb, coalesce(nf, 0) AS nf FROM (SELECT symbol, count(*) AS nb FROM bounded GROUP BY 1) x FULL JOIN (SELECT symbol, count(*) AS nf FROM inside GROUP BY 1) y ON x.symbol = y.symbol),
  m AS (SELECT symbol, CASE WHEN nb >= 105 THEN 'bounded' WHEN nf > nb THEN 'unbounded_fallback_trimmed' ELSE 'bounded_shorter_or_equal_fallback' END AS mode FROM n)""",
          "SELECT symbol, mode, count(*) AS rows, min(CAST(ts AS DATE)) AS first_session FROM (SELECT bounded.symbol, ts, mode FROM bounded JOIN m USING (symbol) WHERE mode <> 'unbounded_fallback_trimmed' UNION ALL SELECT inside.symbol, ts, mode FROM inside JOIN m USING (symbol) WHERE mode = 'unbounded_fallback_trimmed') GROUP BY ALL",
          **columns("symbol", "mode", "rows", "first_session"))
def _(spark, sf):
    bars = tables.sparse_bars(spark, sf)
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("timestamp")))
    bounded = bars.withColumn("back", back).filter("back <= 300 AND timestamp >= TIMESTAMP'2000-06-01'").drop("back")
    got = normalize.resolve_history(bounded, bars, "1999-01-01", "2001-06-30", 105)
    return got.groupBy("symbol", "mode").agg(F.count(F.lit(1)).alias("rows"), F.min(F.to_date("timestamp")).alias("first_session"))


@register("symbol_mapping", sql.SECURITIES, "SELECT symbol, replace(upper(trim(replace(name, '#', '.'))), '.', '-') AS dashed, replace(upper(trim(replace(name, '#', '.'))), '.', '/') AS slashed FROM securities", **columns("symbol", "dashed", "slashed"))
def _(spark, sf):
    df = tables.securities(spark, sf).withColumn("name", F.replace("name", F.lit("#"), F.lit(".")))
    return df.select("symbol", normalize.provider_symbol(F.col("name"), "-").alias("dashed"), normalize.provider_symbol(F.col("name"), "/").alias("slashed"))


@register("universe_validate", sql.SECURITIES, """SELECT sector, count(*) AS securities, CAST(count_if(copies > 1) AS BIGINT) AS duplicates, CAST(count_if(coalesce(trim(symbol), '') = '') AS BIGINT) AS empty_symbols,
  CAST(count_if(symbol <> upper(trim(symbol))) AS BIGINT) AS mapped FROM (SELECT *, count(*) OVER (PARTITION BY upper(trim(symbol))) AS copies FROM securities) GROUP BY sector""", **columns("sector", "securities", "duplicates", "empty_symbols", "mapped"))
def _(spark, sf):
    return normalize.universe_report(tables.securities(spark, sf))


POLICY = {"min_rows": 530, "min_price": 20_000.0, "min_dollar_volume": 1_000_000.0}
ELIGIBLE = """elig AS (SELECT symbol, count(*) AS rows, arg_max(close, ts) AS latest_close, median(close * volume) FILTER (WHERE back <= 20) AS median_dollar_volume
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM sparse) GROUP BY symbol
), reasons AS (SELECT *, CASE WHEN rows < 530 THEN 'insufficient_history' ELSE concat_ws('|', CASE WHEN latest_close < 20000 THEN 'price_below_minimum' END, CASE WHEN median_dollar_volume < 1000000 THEN 'insufficient_dollar_volume' END) END AS reasons FROM elig)"""


@register("eligibility", f"{sql.SPARSE}, {ELIGIBLE}", "SELECT *, reasons = '' AS eligible FROM reasons", **columns("symbol", "rows", "reasons", "eligible", latest_close=2, median_dollar_volume=4))
def _(spark, sf):
    return normalize.eligibility(tables.sparse_bars(spark, sf), **POLICY).withColumn("reasons", F.array_join("reasons", "|"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    bars = normalize.violations(tables.sparse_bars(spark, sf).filter(F.substring("symbol", 5, 2) != "13"))
    broken = F.when(F.substring("symbol", 5, 2) == "17", F.array(F.lit("ohlc"))).otherwise(F.col("violations"))
    return manifests.ingest_manifest(tables.securities(spark, sf), bars.withColumn("violations", broken), **POLICY)


MANIFEST = f"""{sql.SPARSE}, {sql.SECURITIES}, {ELIGIBLE}, manifest AS (
  SELECT s.symbol, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad THEN 0 ELSE rows END AS rows, CASE WHEN bad THEN FALSE ELSE reasons = '' END AS eligible,
         CASE WHEN bad THEN 'market_data_error' ELSE reasons END AS reasons FROM (SELECT symbol, substr(symbol, 5, 2) IN ('13', '17') OR symbol NOT IN (SELECT symbol FROM sparse) AS bad FROM securities) s LEFT JOIN reasons r ON r.symbol = s.symbol)"""


@register("manifest_ingest", MANIFEST, "SELECT * FROM manifest", **columns("symbol", "status", "rows", "eligible", "reasons"))
def _(spark, sf):
    return manifest(spark, sf).withColumn("reasons", F.array_join("reasons", "|"))


@register("manifest_retry_merge", MANIFEST, "SELECT status, attempt, count(*) AS symbols, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT symbol, CASE WHEN status = 'error' THEN 'ok' ELSE status END AS status, CASE WHEN status = 'error' THEN 1 ELSE rows END AS rows, CASE WHEN status = 'error' THEN 2 END AS attempt FROM manifest) GROUP BY ALL", **columns("status", "attempt", "symbols", "rows"))
def _(spark, sf):
    old = manifest(spark, sf)
    retried = old.filter("status = 'error'").select("symbol", F.lit("ok").alias("status"), F.lit(1).cast("long").alias("rows"), F.lit(2).alias("attempt"))
    return manifests.merge_retry(old, retried).groupBy("status", "attempt").agg(F.count(F.lit(1)).alias("symbols"), F.sum("rows").alias("rows"))


@register("manifest_audit", MANIFEST, """SELECT count(*) AS symbols, CAST(count_if(status = 'ok') AS BIGINT) AS successful, CAST(count_if(status <> 'ok') AS BIGINT) AS failed, CAST(count_if(status = 'ok' AND eligible) AS BIGINT) AS eligible,
  CAST(count_if(status = 'ok' AND NOT eligible) AS BIGINT) AS ineligible, min(rows) FILTER (WHERE status = 'ok') AS min_rows, median(rows) FILTER (WHERE status = 'ok') AS median_rows, max(rows) FILTER (WHERE status = 'ok') AS max_rows FROM manifest""",
          **columns("symbols", "successful", "failed", "eligible", "ineligible", "min_rows", "max_rows", median_rows=2))
def _(spark, sf):
    return manifests.audit_manifest(manifest(spark, sf))


@register("reason_histogram", MANIFEST, "SELECT reason, count(*) AS symbols FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM manifest WHERE reasons <> '') GROUP BY reason", **columns("reason", "symbols"))
def _(spark, sf):
    return manifests.reason_histogram(manifest(spark, sf))


@register("manifest_hash", **columns("symbol", "status", "manifest_hash"))
def _(spark, sf):
    return manifests.with_manifest_hash(manifest(spark, sf))


def with_violations(bars: DataFrame) -> DataFrame:
    return normalize.violations(bars)


HISTORY_MODES = ORACLE_SQL["history_resolution"].split(" SELECT symbol, mode, rows, first_session FROM (")[0]


@register("manifest_history", HISTORY_MODES.removeprefix("WITH RECURSIVE ") + f""", {sql.SECURITIES}, chosen AS (SELECT bounded.symbol, ts, close, volume, mode FROM bounded JOIN m USING (symbol) WHERE mode <> 'unbounded_fallback_trimmed'
  UNION ALL SELECT inside.symbol, ts, close, volume, mode FROM inside JOIN m USING (symbol) WHERE mode = 'unbounded_fallback_trimmed'
), facts AS (SELECT symbol, mode, count(*) AS rows, arg_max(close, ts) AS latest, median(close * volume) FILTER (WHERE last_no <= 20) AS mdv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS last_no FROM chosen) GROUP BY ALL)""",
          """SELECT s.symbol, CASE WHEN rows IS NULL THEN 'error' ELSE 'ok' END AS status, coalesce(rows, 0) AS rows, mode, CASE WHEN rows IS NULL THEN 'market_data_error' WHEN rows < 100 THEN 'insufficient_history'
  ELSE concat_ws('|', CASE WHEN latest < 20000 THEN 'price_below_minimum' END, CASE WHEN mdv < 1000000 THEN 'insufficient_dollar_volume' END) END AS reasons FROM securities s LEFT JOIN facts USING (symbol)""",
          **columns("symbol", "status", "rows", "mode", "reasons"))
def _(spark, sf):
    bars = with_violations(tables.sparse_bars(spark, sf))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("timestamp")))
    bounded = bars.withColumn("back", back).filter("back <= 300 AND timestamp >= TIMESTAMP'2000-06-01'").drop("back")
    got = manifests.history_manifest(tables.securities(spark, sf), bounded, bars, "1999-01-01", "2001-06-30", 105, **POLICY | {"min_rows": 100})
    return got.withColumn("reasons", F.array_join("reasons", "|"))


@register("reference_manifest", f"{sql.SPARSE}, {sql.SECURITIES}", """SELECT s.symbol, CASE WHEN n IS NULL OR broken THEN 'error' ELSE 'ok' END AS status, CASE WHEN n IS NULL THEN 'empty price history' WHEN broken THEN 'Invalid OHLC relationships' END AS error,
  coalesce(n, 0) AS rows FROM securities s LEFT JOIN (SELECT symbol, count(*) AS n, substr(symbol, 5, 2) = '17' AS broken FROM sparse WHERE substr(symbol, 5, 2) <> '13' GROUP BY symbol) USING (symbol)""", **columns("symbol", "status", "error", "rows"))
def _(spark, sf):
    bars = with_violations(tables.sparse_bars(spark, sf).filter(F.substring("symbol", 5, 2) != "13"))
    broken = F.when(F.substring("symbol", 5, 2) == "17", F.array(F.lit("ohlc"))).otherwise(F.col("violations"))
    return manifests.reference_manifest(tables.securities(spark, sf), bars.withColumn("violations", broken))


@register("eligible_bars", MANIFEST, "SELECT symbol, count(*) AS rows, sum(close) AS total FROM sparse JOIN manifest m USING (symbol) WHERE status = 'ok' AND eligible GROUP BY symbol", **columns("symbol", "rows", total=2))
def _(spark, sf):
    bars = manifests.eligible_bars(tables.sparse_bars(spark, sf), manifest(spark, sf))
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("total"))


@register("invalid_dates", RAW, "SELECT session_date, count(*) AS bars, count(DISTINCT symbol) AS symbols FROM bars WHERE bad OR volume < 0 GROUP BY session_date", **columns("session_date", "bars", "symbols"))
def _(spark, sf):
    return manifests.invalid_dates(normalize.normalize_bars(raw_rows(spark, sf)))


PAYLOAD_DATE = "1997-05-01"


@register("payload_quarantine", f"{sql.SPARSE}, d AS (SELECT symbol, CAST(ts AS DATE) AS session_date, max(CAST(ts AS DATE) = DATE '{PAYLOAD_DATE}') OVER (PARTITION BY symbol) AS has FROM sparse)",
          f"SELECT symbol, CASE WHEN session_date = DATE '{PAYLOAD_DATE}' THEN 'quarantined' ELSE 'kept' END AS side, count(*) AS rows FROM d GROUP BY ALL", **columns("symbol", "side", "rows"))
def _(spark, sf):
    """Candles of one approved date arrive broken."""
    bars = tables.sparse_bars(spark, sf)
    high = F.when(F.to_date("timestamp") == F.lit(PAYLOAD_DATE).cast("date"), F.col("low") / 2).otherwise(F.col("high")).alias("high")
    candle = F.struct(F.unix_millis("timestamp").alias("datetime"), "open", high, "low", "close", "volume")
    payloads = bars.groupBy("symbol").agg(F.lit(False).alias("empty"), F.collect_list(candle).alias("candles"))
    kept, out = normalize.quarantined_payloads(settled(payloads, "payloads"), (PAYLOAD_DATE,))
    count = lambda df, side: df.groupBy("symbol").agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"))
    return count(kept, "kept").unionByName(count(out, "quarantined"))


@register("error_families", None, "SELECT family, count(*) AS errors FROM (SELECT CASE event_type WHEN 'error' THEN 'http_429_rate_limit' WHEN 'click' THEN 'invalid_ohlc' WHEN 'view' THEN 'empty_history' ELSE event_type END AS family FROM events) GROUP BY family", **columns("family", "errors"))
def _(spark, sf):
    kind = F.col("event_type")
    text = F.when(kind == "error", "HTTP 429 from vendor").when(kind == "click", F.concat(F.lit("Invalid OHLC relationships: "), F.col("event_id"))).when(kind == "view", "no candles").otherwise(F.concat(kind, F.lit(": x")))
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(manifests.error_family(text).alias("family")).agg(F.count(F.lit(1)).alias("errors"))


@register("row_context", f"{RAW}, near AS (SELECT *, max(bad) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM bars)", "SELECT symbol, session_date, bad, close FROM near WHERE near", **columns(*KEYS, "bad", close=2))
def _(spark, sf):
    return by_session(audit.bad_row_context(normalize.normalize_bars(raw_rows(spark, sf))))


@register("history_diagnosis", RAW, "SELECT symbol, count(*) AS rows, CAST(count_if(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS BIGINT) AS null_rows, CAST(count_if(bad) AS BIGINT) AS invalid_rows, min(session_date) AS first, max(session_date) AS last FROM bars GROUP BY symbol", **columns("symbol", "rows", "null_rows", "invalid_rows", "first", "last"))
def _(spark, sf):
    df = audit.null_rows(normalize.normalize_bars(raw_rows(spark, sf)))
    return df.withColumns({"first": F.to_date("first"), "last": F.to_date("last")})


@register("payload_bars", sql.SPARSE, "SELECT symbol, count(*) AS rows, sum(close) AS total, CAST(max(ts) AS DATE) AS last_session FROM sparse GROUP BY symbol", **columns("symbol", "rows", "last_session", total=2))
def _(spark, sf):
    bars = tables.sparse_bars(spark, sf)
    candle = F.struct(F.unix_millis("timestamp").alias("datetime"), "open", "high", "low", "close", "volume")
    payloads = bars.groupBy("symbol").agg(F.lit(False).alias("empty"), F.collect_list(candle).alias("candles"))
    return normalize.bars_of_payloads(payloads).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("total"), F.max(F.to_date("timestamp")).alias("last_session"))


@register("row_hashes", None, """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS h FROM supplier""", **columns("s_suppkey", "h"))
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    return df.select("s_suppkey", row_hash(df).alias("h"))


# ---------------------------------------------------------------- features


def core(spark: SparkSession, sf: str) -> DataFrame:
    return by_session(feature_plans.core_features(tables.bars(spark, sf), method=tables.ewm_method(spark, sf)))


def features(spark: SparkSession, sf: str, wanted=config.FEATURES, *, last: bool = False) -> DataFrame:
    """The wanted features of every dense session (or each symbol's last), from histories; plans.features has the same by windows."""
    return history.feature_rows(tables.order_histories(spark, sf), tables.market(spark, sf), wanted, last=last)


CORE_QUERIES = {
    "returns": columns(*[f"return_{n}d" for n in config.RETURN_WINDOWS], digits=5),
    "ema": columns(*[f"ema_{n}" for n in config.EMA_SPANS], digits=1),
    "price_to_ema": columns(*[f"price_to_ema_{n}" for n in config.EMA_SPANS], digits=5),
    "ema_spreads": columns("ema_9_to_21", "ema_50_to_200", digits=5),
    "rsi": columns("rsi_14", digits=4),
    "volatility": columns("volatility_20d", "volatility_60d", digits=4),
    "downside_volatility": columns("downside_volatility_20d", "downside_volatility_60d", digits=4),
    "drawdown": columns("current_drawdown_60d", digits=5),
    "atr": columns("atr_14", digits=3, atr_pct_14=4),
    "median_dollar_volume": columns("median_dollar_volume_20d", digits=4),
    "relative_volume": columns("relative_volume_20d", digits=4),
}
for _name, _digits in CORE_QUERIES.items():
    register(_name, sql.core(), "SELECT *, CAST(ts AS DATE) AS session_date FROM core", **columns(*KEYS), **_digits)(core)

RELATIVE_QUERIES = {
    "benchmark_excess": columns(*[f"excess_return_{x}_{n}d" for x in ("spy", "sector") for n in config.RELATIVE_WINDOWS], digits=4),
    "rolling_corr": columns(*[f"corr_{x}_60d" for x in (*config.PORTFOLIO_REFERENCES, "sector")], digits=4),
    "rolling_beta": columns("beta_spy_60d", digits=3),
}
for _name, _digits in RELATIVE_QUERIES.items():
    register(_name, sql.features(), "SELECT *, CAST(ts AS DATE) AS session_date FROM features", **columns(*KEYS), **_digits)(lambda spark, sf, wanted=tuple(_digits): features(spark, sf, wanted))

FRAME_DIGITS = {f"ema_{n}": 2 for n in config.EMA_SPANS} | {"rsi_14": 4, "atr_14": 3, "median_dollar_volume_20d": 4, "relative_volume_20d": 4, "beta_spy_60d": 4}
FRAME = columns("sector") | {f: FRAME_DIGITS.get(f, 5) for f in config.FEATURES}
register("latest_snapshot", sql.features(), "SELECT *, CAST(ts AS DATE) AS session_date FROM features QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1", **columns(*KEYS), **FRAME)(
    lambda spark, sf: features(spark, sf, last=True)
)
register("feature_manifest", sql.features(), f"SELECT symbol, sector, count(*) AS rows, {', '.join(f'count({f}) AS n_{f}' for f in config.FEATURES)} FROM features GROUP BY ALL", **columns("symbol", "sector", "rows", *[f"n_{f}" for f in config.FEATURES]))(
    lambda spark, sf: history.feature_counts(tables.order_histories(spark, sf), tables.market(spark, sf), config.FEATURES)
)


@register("feature_hashes", **columns("symbol", "rows", "data_hash"))
def _(spark, sf):
    from ..functions.hashing import table_hash

    df = features(spark, sf)
    return table_hash(df.select("symbol", F.col("session_date").cast("timestamp").alias("timestamp"), *[F.round(f, 6).alias(f) for f in config.FEATURES]), ["symbol"])


@register("feature_parity", None, " UNION ALL ".join(f"SELECT '{f}' AS feature, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS comparisons, 0::BIGINT AS failures" for f in config.FEATURES), **columns("feature", "comparisons", "failures"))
def _(spark, sf):
    """Features as all queries have them, from histories, against window functions and the closed form of the recursive
    averages, at each symbol's last row. Windows need its last sessions, the averages all of its closes."""
    table, market = tables.order_histories(spark, sf), tables.market(spark, sf)
    dated = lambda df: df.withColumnRenamed("session_date", "timestamp")
    bars = dated(history.last_bars(table, market.days)).join(feature_plans.last_averages(history.close_runs(table, market.days)), "symbol")
    references = [F.broadcast(dated(df)) for df in history.market_tables(spark, market)]  # a row a session (and sector)
    among = lambda n: F.unix_date("timestamp").isin(market.days[-n:].tolist())  # noqa: E731 - a symbol has every session from its first one on
    core = feature_plans.core_features(bars, method="given", recent=among(history.ROLLED))
    latest = feature_plans.relative_features(core, *references).filter(among(1))
    return audit.parity(dated(features(spark, sf, last=True)), latest, config.FEATURES)


# ---------------------------------------------------------------- cross-sections and panel


register("winsor_zscore", f"{sql.features()}, last AS (SELECT *, 1 AS one FROM features QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), {sql.z_scores('last', 'z', config.SCORING_FEATURES, 'one')}", "SELECT * FROM z", **columns("symbol"), **columns(*[f"z_{f}" for f in config.SCORING_FEATURES], digits=4))(
    lambda spark, sf: panel_plans.scoring_snapshot(features(spark, sf, config.SCORING_FEATURES, last=True))
)
register("scoring_flags", sql.features(), f"SELECT symbol, CAST({sql.MISSING} AS INTEGER) AS scoring_missing_count, {sql.MISSING} = 0 AS scoring_complete, {', '.join(f'{f} IS NULL AS missing_{f}' for f in config.SCORING_FEATURES)} FROM features QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1", **columns("symbol", "scoring_missing_count", "scoring_complete", *[f"missing_{f}" for f in config.SCORING_FEATURES]))(
    lambda spark, sf: crosssection.missing_flags(features(spark, sf, config.SCORING_FEATURES, last=True), config.SCORING_FEATURES)
)


@register("forward_returns", f"{sql.DENSE}, f AS (SELECT symbol, CAST(ts AS DATE) AS session_date, {', '.join(f'lead(close, {h}) {sql.W} / nullif(close, 0) - 1 AS forward_return_{h}d, CAST(lead(ts, {h}) {sql.W} AS DATE) AS forward_end_{h}d' for h in config.HORIZONS)} FROM dense)", "SELECT * FROM f", **columns(*KEYS, *[f"forward_end_{h}d" for h in config.HORIZONS]), **columns(*[f"forward_return_{h}d" for h in config.HORIZONS], digits=5))
def _(spark, sf):
    df = panel_plans.forward_labels(tables.bars(spark, sf))
    return by_session(df).withColumns({f"forward_end_{h}d": F.to_date(f"forward_end_{h}d") for h in config.HORIZONS})


@register("weekly_sample", f"{sql.DENSE}, w AS (SELECT *, CAST(ts AS DATE) AS session_date, {sql.FRIDAY} AS week FROM dense QUALIFY row_number() OVER (PARTITION BY symbol, week ORDER BY ts DESC) = 1)", "SELECT * FROM w", **columns(*KEYS, close=2))
def _(spark, sf):
    return panel_plans.weekly(tables.bars(spark, sf))


RETURNS = [f"forward_return_{h}d" for h in config.HORIZONS]


def panel(spark: SparkSession, sf: str, wanted, complete: bool = False, *, ex: bool = False) -> DataFrame:
    """The weekly panel's wanted columns, made where the histories are. Group scores are rounded, so that ties don't hang on the
    last bit of either engine."""
    return history.panel_rows(*panel_sources(spark, sf, ex), wanted, complete=complete, negative=config.NEGATIVE)


def panel_sources(spark: SparkSession, sf: str, ex: bool = False):
    return tables.order_histories(spark, sf), tables.market(spark, sf), tables.panel_bounds(spark, sf, [*config.SCORING_FEATURES, *(history.EX if ex else [])])


GROUP_COLUMNS = [f"group_{g}" for g in config.GROUPS]
register("group_scores", sql.panel(), "SELECT * FROM panel", **columns(*KEYS), **columns(*GROUP_COLUMNS, digits=4))(lambda spark, sf: panel(spark, sf, GROUP_COLUMNS))
register("scoring_panel", sql.panel(), "SELECT *, CAST(forward_end_20d AS DATE) AS label_end FROM panel", **columns(*KEYS, "sector", "scoring_complete", "label_end"), **columns(*GROUP_COLUMNS, *[f"forward_return_{h}d" for h in config.HORIZONS], digits=4))(
    lambda spark, sf: panel(spark, sf, [*GROUP_COLUMNS, *RETURNS, "forward_end_20d"]).withColumn("label_end", F.col("forward_end_20d"))
)

FIXED = {"momentum": 0.3, "trend": 0.2, "relative_strength": 0.2, "risk": 0.2, "participation": 0.1}
FIXED_SQL = " + ".join(f"{w} * group_{g}" for g, w in FIXED.items())


def scored_panel(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return panel(spark, sf, [*GROUP_COLUMNS, *more], complete=True).withColumn("score", crosssection.composite(FIXED))


SCORED = f"{sql.panel()}, scored AS (SELECT *, {FIXED_SQL} AS score FROM panel WHERE scoring_complete)"
register("composite_score", SCORED, "SELECT * FROM scored", **columns(*KEYS, score=4))(scored_panel)
register("rank_average", f"{SCORED}, r AS (SELECT *, {sql.rank_of('relative_volume_20d', 'session_date')} AS volume_rank FROM scored)", "SELECT * FROM r", **columns(*KEYS, volume_rank=1))(
    lambda spark, sf: scored_panel(spark, sf, "relative_volume_20d").withColumn("volume_rank", crosssection.average_rank("relative_volume_20d", "session_date"))
)
register("pct_rank", f"{SCORED}, r AS (SELECT *, ({sql.rank_of('relative_volume_20d', 'session_date')}) / count(*) OVER (PARTITION BY session_date) AS volume_rank FROM scored)", "SELECT * FROM r", **columns(*KEYS, volume_rank=6))(
    lambda spark, sf: scored_panel(spark, sf, "relative_volume_20d").withColumn("volume_rank", crosssection.percentile_rank("relative_volume_20d", "session_date"))
)

DAILY = f"{SCORED}, {sql.signal_daily('scored', 'daily', 'score', 'forward_return_20d')}"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_panel(spark, sf, "forward_return_20d").select("session_date", "symbol", "score", "forward_return_20d")
    daily = research.by_dates(rows, "one int", lambda date, d: [((1,), d["score"].to_numpy(), d["forward_return_20d"].to_numpy())])
    return daily.drop("one")


register("rank_ic_daily", DAILY, "SELECT * FROM daily", **columns("session_date", "n", rank_ic=6))(daily)
register("top_bottom_spread", DAILY, "SELECT * FROM daily", **columns("session_date", top_bottom_spread=5))(daily)
register("basket_turnover", DAILY, "SELECT * FROM daily", **columns("session_date", turnover=5))(daily)
SUMMARY_COLUMNS = columns("mean_rank_ic", "median_rank_ic", "mean_spread", "mean_turnover", "positive_spread_rate", "objective", digits=5)
register("evaluate_candidate", DAILY, f"SELECT {sql.SUMMARY} FROM daily", **SUMMARY_COLUMNS)(lambda spark, sf: crosssection.metric_summary(daily(spark, sf)))

# ---------------------------------------------------------------- research

WEIGHTS = [f"w_{g}" for g in config.GROUPS]
register("weight_grid", sql.grid(10), "SELECT * FROM candidates", **columns("candidate_id"), **columns(*WEIGHTS, digits=6))(lambda spark, sf: research.weight_grid(spark))


def complete(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: the grid's candidates and the baselines score the same rows."""
    make = lambda: panel(spark, sf, [*GROUP_COLUMNS, "forward_return_20d", "forward_end_20d"], True)
    return once(spark, "complete", [f"{sf}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")], make)


def coarse_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: a row a date and candidate."""
    make = lambda: research.grid_by_dates(complete(spark, sf), research.weight_grid(spark, 0.5))
    return once(spark, "coarse", [f"{sf}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")], make)


register("candidate_grid_daily", sql.grid_daily(2), "SELECT *, CAST(label_end AS DATE) AS ended FROM daily", **columns("session_date", "candidate_id", "n", "ended"), **columns("rank_ic", "top_bottom_spread", "turnover", digits=5))(
    lambda spark, sf: coarse_daily(spark, sf).withColumn("ended", F.to_date("label_end"))
)
register("candidate_grid_kernel", sql.grid_daily(4), "SELECT *, CAST(label_end AS DATE) AS ended FROM daily", **columns("session_date", "candidate_id", "n", "ended"), **columns("rank_ic", "top_bottom_spread", "turnover", digits=5))(
    lambda spark, sf: research.grid_by_dates(complete(spark, sf), research.weight_grid(spark, 0.25)).withColumn("ended", F.to_date("label_end"))
)
register("candidate_aggregate", sql.grid_daily(2), f"SELECT candidate_id, {sql.SUMMARY} FROM daily GROUP BY candidate_id", **columns("candidate_id"), **SUMMARY_COLUMNS)(
    lambda spark, sf: crosssection.metric_summary(coarse_daily(spark, sf), "candidate_id")
)
WALK = columns("fold", "train_dates", "test_dates", "test_start", "test_end", "candidate_id") | columns(*[f"{side}_{m}" for side in ("train", "test") for m in SUMMARY_COLUMNS], *WEIGHTS, digits=5)


def walk(spark: SparkSession, sf: str) -> DataFrame:
    return research.walk_forward(coarse_daily(spark, sf), research.weight_grid(spark, 0.5)).withColumn("fold", F.col("fold").cast("long"))


register("walk_forward_folds", sql.walk_forward(2), "SELECT * FROM walk", **WALK)(walk)
WALK_MEANS = [f"test_{m}" for m in SUMMARY_COLUMNS] + WEIGHTS
register("walk_forward_summary", sql.walk_forward(2), f"SELECT count(*) AS folds, {', '.join(f'avg({m}) AS {m}' for m in WALK_MEANS)} FROM walk", **columns("folds"), **columns(*WALK_MEANS, digits=5))(
    lambda spark, sf: research.walk_forward_summary(walk(spark, sf))
)


@register("walk_forward_full_grid", **WALK)
def _(spark, sf):
    """All 1001 candidates by the matrix kernel."""
    return research.walk_forward(full_daily(spark, sf), research.weight_grid(spark)).withColumn("fold", F.col("fold").cast("long"))


@register("embargo_train_dates", sql.walk_forward(2), "SELECT slot, test_start, count(DISTINCT session_date) AS train_dates, max(session_date) AS last_train FROM train GROUP BY ALL", **columns("slot", "test_start", "train_dates", "last_train"))
def _(spark, sf):
    d = coarse_daily(spark, sf)
    rows = research.training_rows(d, research.fold_schedule(d))
    return rows.groupBy("slot", "test_start").agg(F.count_distinct("session_date").alias("train_dates"), F.max("session_date").alias("last_train"))


IC_PICK = sql.walk_forward(2).replace("ORDER BY objective DESC NULLS LAST, mean_rank_ic", "ORDER BY mean_rank_ic")
register("ic_only_pick", IC_PICK, "SELECT * FROM walk", **WALK)(
    lambda spark, sf: research.walk_forward(coarse_daily(spark, sf), research.weight_grid(spark, 0.5), order=("mean_rank_ic", "mean_spread")).withColumn("fold", F.col("fold").cast("long"))
)

register("candidate_grid_full_grid", **columns("session_date", "candidate_id", "n", "ended"), **columns("rank_ic", "top_bottom_spread", "turnover", digits=5))(
    lambda spark, sf: full_daily(spark, sf).withColumn("ended", F.to_date("label_end"))
)
register("candidate_aggregate_full_grid", **columns("candidate_id"), **SUMMARY_COLUMNS)(
    lambda spark, sf: crosssection.metric_summary(full_daily(spark, sf), "candidate_id")
)
register("ic_only_pick_full_grid", **WALK)(
    lambda spark, sf: research.walk_forward(full_daily(spark, sf), research.weight_grid(spark), order=("mean_rank_ic", "mean_spread")).withColumn("fold", F.col("fold").cast("long"))
)

K = len(config.GROUPS)
MODELS = "models AS (" + " UNION ALL ".join(
    [f"SELECT 'equal_weight' AS model, {', '.join(f'{1 / K!r} AS w_{g}' for g in config.GROUPS)}"] + [f"SELECT '{g}_only', {', '.join('1.0' if x == g else '0.0' for x in config.GROUPS)}" for g in config.GROUPS]
) + ")"
CHOSEN = " UNION ALL ".join(f"SELECT fold, 'optimized_{n}' AS model, {', '.join(WEIGHTS)} FROM {t} JOIN candidates USING (candidate_id)" for n, t in (("penalized", "best"), ("ic_only", "best_ic")))
BASE = f"""{sql.walk_forward(2)}, {MODELS}, all_models AS (SELECT fold, model, {', '.join(WEIGHTS)} FROM best, models UNION ALL {CHOSEN}
), base_rows AS (SELECT fold, model, session_date, symbol, forward_return_20d, {sql.SCORE} AS score FROM panel JOIN best ON session_date BETWEEN test_start AND test_end JOIN all_models USING (fold)
  WHERE scoring_complete AND forward_return_20d IS NOT NULL), {sql.signal_daily('base_rows', 'base_daily', 'score', 'forward_return_20d', 'fold, model')}, base AS (SELECT fold, model, {sql.SUMMARY} FROM base_daily GROUP BY fold, model)"""


def compared(spark: SparkSession, sf: str, daily: DataFrame, weights: DataFrame) -> DataFrame:
    """The six fixed models, and in each fold the grid's picks by the penalised objective and by IC alone."""
    penalized, ic_only = (settled(research.walk_forward(daily, weights, order=o).withColumn("fold", F.col("fold").cast("long")), "picks") for o in (("objective", "mean_rank_ic", "mean_spread"), ("mean_rank_ic", "mean_spread")))
    return research.baseline_by_dates(complete(spark, sf), penalized, research.baseline_weights(spark), research.optimized_weights(penalized, ic_only))


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return compared(spark, sf, coarse_daily(spark, sf), research.weight_grid(spark, 0.5))


register("baseline_comparison", BASE, "SELECT * FROM base", **columns("fold", "model"), **SUMMARY_COLUMNS)(comparison)
register("baseline_summary", BASE, """SELECT model, count(DISTINCT fold) AS folds, avg(mean_rank_ic) AS mean_rank_ic, median(mean_rank_ic) AS median_fold_rank_ic, avg(median_rank_ic) AS mean_fold_median_rank_ic, avg(mean_spread) AS mean_spread,
  avg(positive_spread_rate) AS mean_positive_spread_rate, avg(mean_turnover) AS mean_turnover, avg(CASE WHEN mean_rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ic_fold_rate FROM base GROUP BY model""",
         **columns("model", "folds"), **columns("mean_rank_ic", "median_fold_rank_ic", "mean_fold_median_rank_ic", "mean_spread", "mean_positive_spread_rate", "mean_turnover", "positive_ic_fold_rate", digits=5))(
    lambda spark, sf: research.baseline_summary(comparison(spark, sf))
)



def full_daily(spark: SparkSession, sf: str) -> DataFrame:
    """All 1001 candidates by the matrix kernel, written once (a row a date and candidate)."""
    make = lambda: research.grid_by_dates(complete(spark, sf), research.weight_grid(spark))
    return once(spark, "grid", [f"{sf}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")], make, settled_and_released)


def full_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return compared(spark, sf, full_daily(spark, sf), research.weight_grid(spark))


register("baseline_comparison_full_grid", **columns("fold", "model"), **SUMMARY_COLUMNS)(full_comparison)
register("baseline_summary_full_grid", **columns("model", "folds"), **columns("mean_rank_ic", "median_fold_rank_ic", "mean_fold_median_rank_ic", "mean_spread", "mean_positive_spread_rate", "mean_turnover", "positive_ic_fold_rate", digits=5))(
    lambda spark, sf: research.baseline_summary(full_comparison(spark, sf))
)

DIAGNOSIS = columns("dates") | columns("mean_rank_ic", "median_rank_ic", "std_rank_ic", "information_ratio", "positive_ic_rate", "mean_spread", "positive_spread_rate", "mean_turnover", digits=5)


def unpivoted(source: str, signals) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT session_date, symbol, '{s}' AS signal, CAST({h} AS INTEGER) AS horizon, round({s}, 9) AS value, forward_return_{h}d AS label FROM {source}" for s in signals for h in config.HORIZONS) + ")"


def diagnosis(with_: str, source: str, signals) -> str:
    return f"{with_}, {unpivoted(source, signals)}, {sql.signal_daily('long', 'daily', 'value', 'label', 'signal, horizon')}"


SIGNALS = [*GROUP_COLUMNS, *[f"z_{f}" for f in config.SCORING_FEATURES]]
register("signal_diagnostics", diagnosis(sql.panel(), "panel", SIGNALS), f"SELECT signal, horizon, {sql.DIAGNOSIS} FROM daily GROUP BY signal, horizon", **columns("signal", "horizon"), **DIAGNOSIS)(
    lambda spark, sf: reduce(DataFrame.unionByName, [settled_and_released(research.diagnose_by_dates(panel(spark, sf, [*some, *RETURNS]), {s: s for s in some}), "signals") for some in (SIGNALS[i : i + 5] for i in range(0, len(SIGNALS), 5))])
)


def correlations_sql(names, complete: str) -> str:
    one = lambda a, b: f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)" if a != b else f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END"
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    daily = f"cd AS (SELECT session_date, {', '.join(f'{one(a, b)} AS c{i}' for i, (a, b) in enumerate(pairs))} FROM panel WHERE {complete} GROUP BY session_date HAVING count(*) >= 50)"
    entries = ", ".join(f"struct_pack(a := '{a}', b := '{b}', correlation := avg(c{i}))" for i, (a, b) in enumerate(pairs))
    return f"{sql.panel()}, {daily}, cm AS (SELECT unnest([{entries}], recursive := true) FROM cd)"


register("group_correlations", correlations_sql(GROUP_COLUMNS, " AND ".join(f"{c} IS NOT NULL" for c in GROUP_COLUMNS)), "SELECT * FROM cm", **columns("a", "b", correlation=5))(
    lambda spark, sf: history.panel_correlations(*panel_sources(spark, sf), GROUP_COLUMNS)
)
Z_COLUMNS = [f"z_{f}" for f in config.SCORING_FEATURES]
register("feature_correlations", correlations_sql(Z_COLUMNS, " AND ".join(f"{c} IS NOT NULL" for c in Z_COLUMNS)), "SELECT * FROM cm", **columns("a", "b", correlation=5))(
    lambda spark, sf: history.panel_correlations(*panel_sources(spark, sf), Z_COLUMNS)
)

EX = [f"momentum_{n}d_ex_20d" for n in (252, 126)]
MOMENTUM = f"{sql.panel()}, m0 AS (SELECT *, {', '.join(f'(1 + return_{n}d) / nullif(1 + return_20d, 0) - 1 AS momentum_{n}d_ex_20d' for n in (252, 126))} FROM panel), {sql.z_scores('m0', 'm', EX, 'session_date')}"
MOMENTUM_SIGNALS = ["z_return_252d", "z_return_126d", *[f"z_{e}" for e in EX]]
register("momentum_ex20", diagnosis(MOMENTUM, "m", MOMENTUM_SIGNALS), f"SELECT signal, horizon, {sql.DIAGNOSIS} FROM daily GROUP BY signal, horizon", **columns("signal", "horizon"), **DIAGNOSIS)(
    lambda spark, sf: research.diagnose_by_dates(panel(spark, sf, [*MOMENTUM_SIGNALS, *RETURNS], ex=True), {s: s for s in MOMENTUM_SIGNALS})
)

PCT = lambda x: f"CASE WHEN {x} IS NOT NULL THEN ({sql.rank_of(x, 'session_date')}) / CAST(count({x}) OVER (PARTITION BY session_date) AS DOUBLE) END"

LEGS = ["rank_momentum_252d_ex_20d", "rank_ema_50_to_200"]
STUDY = f"""{MOMENTUM}, v AS (SELECT *, {', '.join(f'round({x}, 9) AS v_{x}' for x in ('return_252d', 'momentum_252d_ex_20d', 'ema_50_to_200'))} FROM m
), ranks AS (SELECT *, {', '.join(f"{PCT(f'v_{x}')} AS rank_{x}" for x in ('return_252d', 'momentum_252d_ex_20d', 'ema_50_to_200'))} FROM v
), study AS (SELECT *, ({' + '.join(LEGS)}) / 2 AS compact_alpha_blend FROM ranks)"""
STUDY_FOLDS = f"""{sql.walk_forward(2)}, {STUDY.removeprefix(sql.panel() + ', ')}, study_rows AS (SELECT fold, candidate, horizon, session_date, symbol, value, label FROM ({' UNION ALL '.join(f"SELECT session_date, symbol, '{n}' AS candidate, CAST({h} AS INTEGER) AS horizon, round({c}, 9) AS value, forward_return_{h}d AS label FROM study" for n, c in research.COMPACT_CANDIDATES.items() for h in config.HORIZONS)}) JOIN best ON session_date BETWEEN test_start AND test_end),
{sql.signal_daily('study_rows', 'study_daily', 'value', 'label', 'fold, candidate, horizon')}, by_fold AS (SELECT fold, candidate, horizon, {sql.DIAGNOSIS} FROM study_daily GROUP BY fold, candidate, horizon)"""
STUDY_MEANS = ("mean_rank_ic", "median_rank_ic", "positive_ic_rate", "mean_spread", "positive_spread_rate")


def study(spark: SparkSession, sf: str) -> DataFrame:
    """The folds' windows follow from the dates alone, whatever the grid."""
    folds = [(r["fold"], r["test_start"], r["test_end"]) for r in walk(spark, sf).select("fold", "test_start", "test_end").collect()]
    return research.diagnose_by_dates(research.compact_candidates(compact_panel(spark, sf, *RETURNS)), research.COMPACT_CANDIDATES, "candidate", folds=folds)


def compact_panel(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return panel(spark, sf, ["return_252d", "return_20d", "ema_50_to_200", *more])


register("compact_alpha", STUDY, "SELECT * FROM study", **columns(*KEYS), **columns(*research.COMPACT_CANDIDATES.values(), digits=5))(lambda spark, sf: research.compact_candidates(compact_panel(spark, sf)))
register("compact_by_fold", STUDY_FOLDS, "SELECT * FROM by_fold", **columns("fold", "candidate", "horizon"), **DIAGNOSIS)(study)
register("compact_candidates", STUDY_FOLDS, f"SELECT horizon, candidate, count(DISTINCT fold) AS folds, {', '.join(f'avg({m}) AS {m}' for m in STUDY_MEANS)} FROM by_fold GROUP BY horizon, candidate", **columns("horizon", "candidate", "folds"), **columns(*STUDY_MEANS, digits=5))(
    lambda spark, sf: research.compact_study_summary(study(spark, sf))
)
register("compact_leg_correlation", f"{STUDY}, cd AS (SELECT covar_pop({', '.join(LEGS)}) / nullif(stddev_pop({LEGS[0]}) * stddev_pop({LEGS[1]}), 0) AS c FROM study WHERE {' AND '.join(f'{c} IS NOT NULL' for c in LEGS)} GROUP BY session_date HAVING count(*) >= 50)",
         f"SELECT '{LEGS[0]}' AS a, '{LEGS[1]}' AS b, avg(c) AS correlation FROM cd", **columns("a", "b", correlation=5))(
    lambda spark, sf: crosssection.mean_correlations(research.compact_candidates(compact_panel(spark, sf)), LEGS).filter("a <> b")
)


# ---------------------------------------------------------------- providers


def other_provider(bars: DataFrame) -> DataFrame:
    """A second vendor's bars: some adjusted by a dividend, some with single odd closes, four hours later."""
    no = tables.symbol_number()
    odd = F.when(no % 10 == 0, 0.95).when((no % 7 == 0) & (F.to_date("timestamp") == F.lit("1998-06-15").cast("date")), 1.02).when((no % 11 == 0) & F.to_date("timestamp").between("1998-01-01", "1998-03-31"), 1.01).otherwise(1.0)
    volume = F.col("volume") + F.when((no % 13 == 0) & (F.year("timestamp") == 1997), 1.0).otherwise(0.0)
    return bars.withColumns({"close": F.col("close") * odd, "volume": volume, "timestamp": F.col("timestamp") + F.expr("INTERVAL 4 HOURS")})


PROVIDERS = f"""{sql.DENSE}, d AS (SELECT *, CAST(ts AS DATE) AS session_date, CAST(substr(symbol, 2) AS BIGINT) AS no FROM dense
), both_sides AS (SELECT *, ts + INTERVAL 4 HOUR AS other_ts, volume + CASE WHEN no % 13 = 0 AND year(ts) = 1997 THEN 1 ELSE 0 END AS other_volume, close * CASE WHEN no % 10 = 0 THEN 0.95 WHEN no % 7 = 0 AND session_date = DATE '1998-06-15' THEN 1.02 WHEN no % 11 = 0 AND session_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' THEN 1.01 ELSE 1.0 END AS other FROM d
), diff AS (SELECT *, abs(other / close - 1) * 10000 AS bps, other / close AS close_ratio FROM both_sides
), cmp AS (SELECT symbol, count(*) AS overlap_rows, max(bps) AS max_bps, median(bps) AS median_bps, CAST(count_if(bps > 5) AS BIGINT) AS rows_over_tolerance, median(close_ratio) AS median_ratio, avg(CASE WHEN volume = other_volume THEN 1.0 ELSE 0.0 END) AS volume_match_rate, max(abs(epoch(other_ts) - epoch(ts))) / 3600 AS max_offset_hours FROM diff GROUP BY symbol
), classes AS (SELECT *, CASE WHEN rows_over_tolerance = 0 THEN 'clean' WHEN median_bps > 5 OR abs(median_ratio - 1) > 0.005 THEN 'persistent_adjustment_basis'
  WHEN rows_over_tolerance = 1 OR rows_over_tolerance / CAST(overlap_rows AS DOUBLE) <= 0.01 THEN 'isolated_vendor_difference' ELSE 'localized_adjustment_window' END AS classification FROM cmp)"""


@register("cross_provider_audit", PROVIDERS, "SELECT *, CASE WHEN classification = 'clean' THEN 'ok' ELSE 'review' END AS status FROM classes",
          **columns("symbol", "overlap_rows", "rows_over_tolerance", "classification", "status"), **columns("max_bps", "median_bps", "median_ratio", "volume_match_rate", "max_offset_hours", digits=4))
def _(spark, sf):
    bars = tables.bars(spark, sf)
    return audit.compare_providers(bars, other_provider(bars))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["latest_snapshot"](spark, sf_dir)
