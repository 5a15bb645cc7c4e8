"""The 37 point-in-time features of a security, as one plan over (symbol, timestamp) rows of all securities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.timeseries import change, ewm, ewm_by_kernel, ordered, ratio, rolling, rolling_beta, rolling_corr, trailing
from ..operators.normalize import require


def _averages(df: DataFrame, method: str) -> DataFrame:
    """e_<span> and the smoothed gain and loss, by the closed form (bounded histories) or the kernel (any); or as df has them."""
    if method == "given":
        return df
    spans, wilder = {f"e_{n}": 2 / (n + 1) for n in config.EMA_SPANS}, 1 / config.RSI_WINDOW
    if method == "closed":
        means = {name: ewm(F.col("close"), F.col("__t"), a) for name, a in spans.items()}
        return df.withColumns(means | {name: ewm(F.col(c), F.col("__t") - 1, wilder) for name, c in (("__g", "__gain"), ("__l", "__loss"))})
    return ewm_by_kernel(df, {name: ("close", a) for name, a in spans.items()} | {"__g": ("__gain", wilder), "__l": ("__loss", wilder)})


def core_features(bars: DataFrame, *, method: str = "kernel", recent: Column | None = None) -> DataFrame:
    """bars (unique by symbol and timestamp) with the 26 core features.

    method="closed" computes the recursive averages with window functions alone and needs at most CLOSED_FORM_ROWS rows
    a symbol; "kernel" hands each symbol's closes to pandas once; "given" takes those of last_averages() that bars bring.
    Rows that are not recent only serve the returns of later ones and are left out of the result."""
    require(bars, ("symbol", "timestamp", "open", "high", "low", "close", "volume"))
    close, before = F.col("close"), F.lag("close").over(ordered())
    df = bars.withColumns({"__pc": before, "__t": F.row_number().over(ordered()) - 1, **{f"return_{n}d": change(close, n) for n in config.RETURN_WINDOWS}})
    df = df if recent is None else df.filter(recent)
    move = close - F.col("__pc")
    df = df.withColumns(
        {
            "__gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "__loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))),
            "__down": F.pow(F.when(F.col("return_1d") < 0, F.col("return_1d")).when(F.col("return_1d").isNotNull(), 0.0), 2.0),
            "__range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__pc")), F.abs(F.col("low") - F.col("__pc"))),
            "__value": close * F.col("volume"),
        }
    )
    df = _averages(df, method)
    year = math.sqrt(config.SESSIONS_PER_YEAR)
    g, l, t = F.col("__g"), F.col("__l"), F.col("__t")
    df = df.withColumns(
        {f"ema_{n}": F.when(t >= n - 1, F.col(f"e_{n}")) for n in config.EMA_SPANS}
        | {"rsi_14": F.when(t >= config.RSI_WINDOW, F.when(l == 0, F.when(g > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(g, l))))}
        | {f"volatility_{n}d": rolling(F.stddev_samp, F.col("return_1d"), n) * year for n in config.VOLATILITY_WINDOWS}
        | {f"downside_volatility_{n}d": F.sqrt(rolling(F.avg, F.col("__down"), n)) * year for n in config.VOLATILITY_WINDOWS}
        | {
            "current_drawdown_60d": ratio(close, rolling(F.max, close, config.DRAWDOWN_WINDOW)) - 1,
            "atr_14": rolling(F.avg, F.col("__range"), config.ATR_WINDOW),
            "median_dollar_volume_20d": F.when(F.count("__value").over(trailing(config.LIQUIDITY_WINDOW)) == config.LIQUIDITY_WINDOW, F.percentile("__value", 0.5).over(trailing(config.LIQUIDITY_WINDOW))),
            "relative_volume_20d": ratio(F.col("volume"), rolling(F.avg, F.col("volume"), config.LIQUIDITY_WINDOW)),
        }
    )
    df = df.withColumns(
        {f"price_to_ema_{n}": ratio(close, F.col(f"ema_{n}")) - 1 for n in config.EMA_SPANS}
        | {"ema_9_to_21": ratio(F.col("ema_9"), F.col("ema_21")) - 1, "ema_50_to_200": ratio(F.col("ema_50"), F.col("ema_200")) - 1, "atr_pct_14": ratio(F.col("atr_14"), close)}
    )
    return df.select(*bars.columns, *config.CORE_FEATURES)


def relative_features(features: DataFrame, benchmarks: DataFrame, sectors: DataFrame) -> DataFrame:
    """The 11 features against benchmarks, from core features with a sector column.

    benchmarks has a close for each portfolio reference (columns of config.PORTFOLIO_REFERENCES) by timestamp, sectors
    one by timestamp and sector (sector_close). Sessions must agree exactly; nothing is carried forward. Both tables have
    a row a session (and sector); adaptive execution broadcasts them when they turn out small."""
    df = features.join(benchmarks, "timestamp", "left").join(sectors, ["timestamp", "sector"], "left")
    labels = {x: x for x in config.PORTFOLIO_REFERENCES} | {"sector": "sector_close"}
    # as the asset's rows have it: the benchmark's returns are shifted on them too
    df = df.withColumns({f"__r_{x}": change(F.col(c), 1) for x, c in labels.items()} | {f"__b_{x}_{n}": change(F.col(labels[x]), n) for x in ("spy", "sector") for n in config.RELATIVE_WINDOWS})
    n = config.CORRELATION_WINDOW
    df = df.withColumns(
        {f"excess_return_{x}_{k}d": F.col(f"return_{k}d") - F.col(f"__b_{x}_{k}") for x in ("spy", "sector") for k in config.RELATIVE_WINDOWS}
        | {f"corr_{x}_{n}d": rolling_corr(F.col("return_1d"), F.col(f"__r_{x}"), n) for x in labels}
        | {f"beta_spy_{n}d": rolling_beta(F.col("return_1d"), F.col("__r_spy"), n)}
    )
    return df.select(*features.columns, *config.RELATIVE_FEATURES)


def feature_frame(bars: DataFrame, universe: DataFrame, benchmarks: DataFrame, sectors: DataFrame, *, method: str = "kernel") -> DataFrame:
    """All 37 features of the bars' symbols (universe: symbol, sector).

    A symbol that the universe lacks fails the run when its rows are computed, a sector without benchmark at once."""
    require_known_sectors(universe, sectors)
    known = universe.select("symbol", "sector", F.lit(True).alias("__known"))
    df = core_features(bars, method=method).join(known, "symbol", "left")
    unknown = F.raise_error(F.concat(F.lit("not in the universe: "), F.col("symbol")))
    df = df.withColumn("sector", F.when(F.col("__known"), F.col("sector")).otherwise(unknown)).drop("__known")
    return relative_features(df, benchmarks, sectors)


def with_benchmark_names(features: DataFrame, names: dict[str, str] = config.SECTOR_BENCHMARKS) -> DataFrame:
    """features with sector_benchmark, the symbol of the fund that stands for a row's sector; null for other sectors."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return features.withColumn("sector_benchmark", F.try_element_at(F.create_map(*pairs), F.col("sector")))


def reference_symbols(portfolio: tuple[str, ...] = config.PORTFOLIO_REFERENCES, sectors: dict[str, str] = config.SECTOR_BENCHMARKS) -> list[str]:
    """All symbols that features refer to, each once, portfolio references first."""
    return list(dict.fromkeys([x.upper() for x in portfolio] + list(sectors.values())))


def require_known_sectors(universe: DataFrame, known: DataFrame) -> DataFrame:
    """universe; raises for sectors without a benchmark."""
    if odd := [r["sector"] for r in universe.join(known, "sector", "left_anti").select("sector").distinct().limit(5).collect()]:
        raise ValueError(f"no benchmark for sectors {odd}")
    return universe


def last_averages(runs: DataFrame) -> DataFrame:
    """symbol, e_<span>, __g and __l at each symbol's last session, by the closed form as plain sums over its runs of equal
    closes (plans.history.close_runs): a run's sessions have a geometric series of weights. Null where a close is."""
    n, wilder = F.col("sessions"), 1 / config.RSI_WINDOW
    left = lambda alpha, sessions: F.pow(F.lit(1 - alpha), sessions)
    share = lambda alpha: left(alpha, n - F.col("stop")) - F.when(F.col("start") > 0, left(alpha, n - F.col("start"))).otherwise(0.0)
    move = F.when(F.col("start") > 0, F.col("close") - F.col("before")).otherwise(0.0)
    once = F.when(F.col("start") == 1, left(wilder, n - 2)).otherwise(wilder * left(wilder, n - 1 - F.col("start")))  # session 1 is the seed
    sums = {f"e_{k}": F.col("close") * share(2 / (k + 1)) for k in config.EMA_SPANS} | {"__g": F.greatest(move, F.lit(0.0)) * once, "__l": F.greatest(-move, F.lit(0.0)) * once}
    return runs.groupBy("symbol").agg(*[F.when(F.count_if(F.col("close").isNull()) == 0, F.sum(x)).alias(c) for c, x in sums.items()])


def latest_rows(df: DataFrame) -> DataFrame:
    """Each symbol's last row."""
    rest = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*rest), "timestamp").alias("r")).select("symbol", *[F.col("r")[c].alias(c) for c in rest])
