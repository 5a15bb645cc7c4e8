"""The weekly research panel: labels, sampling, standard scores and group scores by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.timeseries import ordered, ratio
from ..operators.crosssection import group_scores, missing_flags, winsor_z


def forward_labels(df: DataFrame, horizons: tuple[int, ...] = config.HORIZONS) -> DataFrame:
    """forward_return_<h>d and the timestamp that ends it."""
    later = {f"forward_return_{h}d": ratio(F.lead("close", h).over(ordered()), F.col("close")) - 1 for h in horizons}
    return df.withColumns(later | {f"forward_end_{h}d": F.lead("timestamp", h).over(ordered()) for h in horizons})


def week_end(timestamp: str = "timestamp"):
    """The Friday that ends a date's week."""
    return F.next_day(F.date_sub(F.to_date(timestamp), 1), "FRI")


def weekly(df: DataFrame) -> DataFrame:
    """Each symbol's last row in each week, with its session_date."""
    last = Window.partitionBy("symbol", "__week").orderBy(F.desc("timestamp"))
    df = df.withColumns({"session_date": F.to_date("timestamp"), "__week": week_end()})
    return df.withColumn("__no", F.row_number().over(last)).filter("__no = 1").drop("__no", "__week")


def enough_rows(df: DataFrame, min_n: int = config.MIN_CROSS_SECTION, by: str = "session_date") -> DataFrame:
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(by))).filter(F.col("__n") >= min_n).drop("__n")


def scoring_snapshot(latest: DataFrame, *, min_n: int = config.MIN_CROSS_SECTION, features=config.SCORING_FEATURES) -> DataFrame:
    """One cross-section (a row per symbol) with z_, missing_ and scoring_ columns."""
    return missing_flags(winsor_z(latest.withColumn("__all", F.lit(1)), features, "__all", min_n=min_n), features).drop("__all")


def scoring_panel(features: DataFrame, *, min_n: int = config.MIN_CROSS_SECTION) -> DataFrame:
    """Features of all sessions to the panel: timestamp, session_date, symbol, sector, raw features, group scores,
    labels and scoring_complete, for the weekly dates with at least min_n symbols."""
    df = enough_rows(weekly(forward_labels(features)), min_n)
    df = group_scores(missing_flags(winsor_z(df, config.SCORING_FEATURES, min_n=min_n), config.SCORING_FEATURES))
    labels = [f"forward_{kind}_{h}d" for kind in ("return", "end") for h in config.HORIZONS]
    return df.select("timestamp", "session_date", "symbol", "sector", *config.SCORING_FEATURES, *[f"group_{g}" for g in config.GROUPS], *labels, "scoring_complete")
