"""Per-date operators: standard scores, ranks, baskets and what a signal tells about a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.timeseries import ratio
from ..materialize import settled


def winsor_z(df: DataFrame, features: list[str] | tuple[str, ...], by: str = "session_date", *, min_n: int = config.MIN_CROSS_SECTION, bounds: tuple[float, float] = config.WINSOR, negative: tuple[str, ...] = config.NEGATIVE) -> DataFrame:
    """df with z_<feature>: values clipped to the bounds' quantiles, centred and scaled by the population deviation of
    the clipped values, turned so that more is better. Null with fewer than min_n values or without spread."""
    xs = Window.partitionBy(by)
    df = df.withColumns({f"__q_{f}": F.when(F.count(f).over(xs) >= min_n, F.percentile(f, list(bounds)).over(xs)) for f in features})
    df = df.withColumns({f"__c_{f}": F.when(F.col(f).isNotNull() & F.col(f"__q_{f}").isNotNull(), F.greatest(F.least(F.col(f), F.col(f"__q_{f}")[1]), F.col(f"__q_{f}")[0])) for f in features})
    sign = lambda f: -1 if f in negative else 1
    df = df.withColumns({f"z_{f}": sign(f) * ratio(F.col(f"__c_{f}") - F.avg(f"__c_{f}").over(xs), F.stddev_pop(f"__c_{f}").over(xs)) for f in features})
    return df.drop(*[f"__q_{f}" for f in features], *[f"__c_{f}" for f in features])


def missing_flags(df: DataFrame, features: list[str] | tuple[str, ...]) -> DataFrame:
    """missing_<feature>, scoring_missing_count and scoring_complete, from the raw values."""
    df = df.withColumns({f"missing_{f}": F.col(f).isNull() for f in features})
    df = df.withColumn("scoring_missing_count", sum((F.col(f"missing_{f}").cast("int") for f in features), F.lit(0)))
    return df.withColumn("scoring_complete", F.col("scoring_missing_count") == 0)


def guard_no_scores(df: DataFrame, forbidden: tuple[str, ...] = ("score", "composite_score", "rank", "scanner_rank")) -> DataFrame:
    if found := sorted(set(forbidden) & set(df.columns)):
        raise ValueError(f"scores don't belong into this table: {', '.join(found)}")
    return df


def group_scores(df: DataFrame, groups: dict[str, tuple[str, ...]] = config.GROUPS) -> DataFrame:
    """group_<name>: mean of the group's standard scores, null where any is."""
    return df.withColumns({f"group_{g}": sum((F.col(f"z_{f}") for f in fs[1:]), F.col(f"z_{fs[0]}")) / len(fs) for g, fs in groups.items()})


def composite(weights: dict[str, float | Column]) -> Column:
    """Weighted sum of group scores; null where any group is, whatever its weight."""
    terms = [F.col(f"group_{g}") * (w if isinstance(w, Column) else F.lit(float(w))) for g, w in weights.items()]
    return sum(terms[1:], terms[0])


def average_rank(x: str, *by: str) -> Column:
    """Rank among the values of a group, ties sharing their mean; null for null."""
    ties, order = Window.partitionBy(*by, x), Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def percentile_rank(x: str, *by: str) -> Column:
    return average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by))


def signal_metrics(df: DataFrame, signal: str, label: str, *, keys: tuple[str, ...] = (), date: str = "session_date", end: str | None = None, ties: str = "symbol", share: float = config.BASKET_SHARE, min_n: int = config.MIN_CROSS_SECTION) -> DataFrame:
    """Per date (and keys): rank_ic, top_bottom_spread, turnover and n.

    Rank IC is the correlation of average ranks. Baskets hold max(1, floor(share n)) rows. With ties="symbol" the order
    is signal descending, symbol ascending, top from its start and bottom from its end; with ties="stable" it is signal
    and symbol ascending, bottom from its start and top from its end. Turnover is the share of the top basket that the
    previous valid date's lacks."""
    by = (*keys, date)
    df = df.filter(F.col(signal).isNotNull() & F.col(label).isNotNull())
    df = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).filter(F.col("__n") >= min_n)
    best = Window.partitionBy(*by).orderBy(F.desc(signal), F.asc("symbol"))
    rising = Window.partitionBy(*by).orderBy(F.asc(signal), F.asc("symbol"))
    df = df.withColumns({"__a": average_rank(signal, *by), "__b": average_rank(label, *by), "__k": F.greatest(F.lit(1), F.floor(F.col("__n") * share + 1e-9)).cast("int")})
    df = df.withColumn("__r", F.row_number().over(best if ties == "symbol" else rising))
    first, last = F.col("__r") <= F.col("__k"), F.col("__r") > F.col("__n") - F.col("__k")
    top, bottom = (first, last) if ties == "symbol" else (last, first)
    daily = df.groupBy(*by).agg(
        F.max("__n").alias("n"),
        ratio(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")).alias("rank_ic"),
        (F.avg(F.when(top, F.col(label))) - F.avg(F.when(bottom, F.col(label)))).alias("top_bottom_spread"),
        F.collect_set(F.when(top, F.col("symbol"))).alias("__top"), *([F.max(end).alias("label_end")] if end else []),
    )
    return turnover(daily, keys, date)


def turnover(daily: DataFrame, keys: tuple[str, ...], date: str = "session_date", top: str = "__top") -> DataFrame:
    before = F.lag(top).over(Window.partitionBy(*keys).orderBy(date)) if keys else F.lag(top).over(Window.partitionBy(F.lit(1)).orderBy(date))
    return daily.withColumn("turnover", F.when(before.isNotNull(), 1 - F.size(F.array_intersect(F.col(top), before)) / F.size(top))).drop(top)


def metric_summary(daily: DataFrame, *keys: str, penalty: float = config.TURNOVER_PENALTY) -> DataFrame:
    """Means over dates; a spread that is missing is not positive."""
    return daily.groupBy(*keys).agg(
        F.avg("rank_ic").alias("mean_rank_ic"), F.median("rank_ic").alias("median_rank_ic"), F.avg("top_bottom_spread").alias("mean_spread"),
        F.avg("turnover").alias("mean_turnover"), F.avg(F.when(F.col("top_bottom_spread") > 0, 1.0).otherwise(0.0)).alias("positive_spread_rate"),
        (F.avg("rank_ic") - penalty * F.avg("turnover")).alias("objective"),
    )


def signal_summary(daily: DataFrame, *keys: str) -> DataFrame:
    """metric_summary's kin for diagnostics: population deviation, information ratio and hit rates."""
    deviation = F.stddev_pop("rank_ic")
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dates"), F.avg("rank_ic").alias("mean_rank_ic"), F.median("rank_ic").alias("median_rank_ic"), deviation.alias("std_rank_ic"),
        ratio(F.avg("rank_ic"), deviation).alias("information_ratio"), F.avg(F.when(F.col("rank_ic") > 0, 1.0).otherwise(0.0)).alias("positive_ic_rate"),
        F.avg("top_bottom_spread").alias("mean_spread"), F.avg(F.when(F.col("top_bottom_spread") > 0, 1.0).otherwise(0.0)).alias("positive_spread_rate"), F.avg("turnover").alias("mean_turnover"),
    )


def mean_correlations(df: DataFrame, columns: list[str], by: str = "session_date", *, min_n: int = config.MIN_CROSS_SECTION) -> DataFrame:
    """(a, b, correlation): per-date Pearson over rows complete in all columns, averaged over dates with min_n rows.

    The columns are written and read back first: their own expressions, often windows, would be copied into every pair
    and into what the optimizer infers from the filter."""
    df = settled(df.select(by, *columns), "correlated").dropna(subset=columns)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(columns) for b in columns[i:]]
    long = df.select(by, F.explode(F.array(*pairs)).alias("e")).select(by, "e.*")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    daily = long.groupBy(by, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.when(F.col("a") == F.col("b"), F.when(spread > 0, 1.0)).otherwise(ratio(F.covar_pop("x", "y"), spread)).alias("c"))
    return daily.filter(F.col("n") >= min_n).groupBy("a", "b").agg(F.avg("c").alias("correlation"))
