"""Per-symbol window functions. All share one window specification, so that Catalyst plans one shuffle and one sort."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Above this many rows a symbol, powers in the closed form of the shortest span come near the end of the double range.
CLOSED_FORM_ROWS = 3000


def ordered() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("timestamp")


def trailing(n: int) -> WindowSpec:
    return ordered().rowsBetween(1 - n, 0)


def rolling(aggregate: Callable[[Column], Column], x: Column, n: int) -> Column:
    """aggregate over the last n rows; null unless all n values are there."""
    return F.when(F.count(x).over(trailing(n)) == n, aggregate(x).over(trailing(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def change(x: Column, n: int) -> Column:
    return ratio(x, F.lag(x, n).over(ordered())) - 1


def rolling_corr(x: Column, y: Column, n: int) -> Column:
    """Pearson over n rows where both are there; null for constant input (corr itself fails there under ANSI)."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    w = trailing(n)
    return F.when(F.count(x).over(w) == n, ratio(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)))


def rolling_beta(x: Column, y: Column, n: int) -> Column:
    """Slope of x on y over n rows."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    w = trailing(n)
    return F.when(F.count(x).over(w) == n, ratio(F.covar_samp(x, y).over(w), F.var_samp(y).over(w)))


def ewm(x: Column, step: Column, alpha: float) -> Column:
    """The recursion e = (1 - alpha) e + alpha x, seeded with the value of step 0, in closed form.

    For at most CLOSED_FORM_ROWS steps; x must have no gaps from step 0 on (before it, it counts as nothing)."""
    keep = 1 - alpha
    term = F.when(step == 0, x).when(step > 0, alpha * x * F.pow(F.lit(keep), -step))
    return F.sum(term).over(ordered().rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(keep), step)


def ewm_by_kernel(df: DataFrame, outputs: dict[str, tuple[str, float]]) -> DataFrame:
    """df with exponential means named by outputs, {name: (column, alpha)}, for histories of any length.

    A symbol's rows go to one pandas call; a symbol has some thousand sessions at most."""
    schema = df.withColumns({name: F.lit(None).cast("double") for name in outputs}).schema

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp", kind="stable")
        return pdf.assign(**{name: pdf[c].ewm(alpha=a, adjust=False).mean() for name, (c, a) in outputs.items()})

    return df.groupBy("symbol").applyInPandas(kernel, schema)
