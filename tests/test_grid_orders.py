"""The grid's orders by integers, its baskets from span to span, and what they cost."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosscut import config
from crosscut.plans import research

GROUPS = [f"group_{g}" for g in config.GROUPS]
GRID = [[a / 10, b / 10, c / 10, d / 10, (10 - a - b - c - d) / 10] for a in range(11) for b in range(11 - a) for c in range(11 - a - b) for d in range(11 - a - b - c)]


def same_orders(groups, weights, integers=True):
    """grid_orders() against a stable argsort of the floating sums, and their ties."""
    got = list(research.grid_orders(groups, weights, research._units(weights)))
    assert len(got) == len(weights)
    tied = 0
    for w, g in zip(weights, got):
        score = research._weighted(groups, w)
        assert isinstance(g, research.Sorted) == integers
        if integers:
            order = np.argsort(score, kind="stable")
            np.testing.assert_array_equal(g.order, order)
            ties = score[order][1:] == score[order][:-1]
            assert g.same is None and not ties.any() or (g.same == ties).all()
            tied += int((~ties & (np.abs(np.diff(score[order])) < 1e-11)).sum())
        else:
            np.testing.assert_array_equal(g, score)
    return tied


def test_orders_are_those_of_the_floating_sums():
    rng = np.random.default_rng(1)
    distinct = [np.round(rng.normal(size=700), 9) for _ in GROUPS]
    same_orders(distinct, GRID[::7])
    same_orders([np.tile(x[:60], 7) for x in distinct], GRID[::7])
    coarse = [np.round(rng.normal(size=700), 1) for _ in GROUPS]
    assert same_orders(coarse, GRID[::7]) > 1000  # sums that only last bits tell apart
    same_orders([np.zeros(3) for _ in GROUPS], GRID[:5])
    same_orders([x[:1] for x in distinct], GRID[:5])


def test_what_is_not_whole_or_too_large_stays_floating():
    rng = np.random.default_rng(2)
    fine = [rng.normal(size=50) for _ in GROUPS]
    same_orders(fine, GRID[:20], integers=False)
    same_orders([np.round(x, 9) * 1e6 for x in fine], GRID[:20], integers=False)
    whole = [np.round(x, 9) for x in fine]
    assert research._units([[1 / np.pi, 1 - 1 / np.pi, 0, 0, 0]]) is None
    same_orders(whole, [[1 / np.pi, 1 - 1 / np.pi, 0.0, 0.0, 0.0]], integers=False)
    same_orders(whole, [[1 / 3, 1 / 3, 1 / 3, 0.0, 0.0], [0.0, 0.0, 0.0, 0.5, 0.5]])


@pytest.mark.parametrize("names", ["S{:05d}", "S{}", "{}", "S{:05d}x", "mixed"])
def test_grid_as_operators_have_it(spark, names):
    """Copies, ties, a date with too few rows at the edge of a span, and symbols of several kinds."""
    rng = np.random.default_rng(5)
    rows = []
    for d in range(24):
        date = dt.date(2025, 1, 3) + dt.timedelta(weeks=d)
        for s in range(60 if d not in (8, 15) else 20):
            x = np.round(np.random.default_rng(d * 100 + s % 40).normal(size=5), 9 if d % 2 else 1)
            symbol = names.format(s * 37) if names != "mixed" else f"S{s * 37}" if d < 12 or s % 2 else f"T-{s}"
            rows.append((date, symbol, *map(float, x), float(np.round(rng.normal(), 2)), dt.datetime.combine(date, dt.time()) + dt.timedelta(days=28)))
    df = spark.createDataFrame(rows, "session_date date, symbol string, " + ", ".join(f"{g} double" for g in GROUPS) + ", forward_return_20d double, forward_end_20d timestamp")
    weights = research.weight_grid(spark, 0.5)
    want, got = (f(df, weights).toPandas().sort_values(["session_date", "candidate_id"]).reset_index(drop=True) for f in (research.grid_daily, research.grid_by_dates))
    assert len(got) == len(want) == 22 * 15 and got["turnover"].notna().sum() == 21 * 15
    for c in ("session_date", "candidate_id", "n", "label_end"):
        assert (got[c] == want[c]).all()
    for c in ("rank_ic", "top_bottom_spread", "turnover"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-12, equal_nan=True)


def test_baskets_between_spans():
    for names in (["S00001", "S00002", "S00300", "S70000"], ["S9", "S10", "S100"], ["a/b", "c", "é"]):
        names = np.array(sorted(names), object)
        for held in ([0], [0, 2], list(range(len(names)))):
            blob = research._packed(names, research._numbers(names), np.array(held))
            plain = research._packed(names, None, np.array([0]))
            assert research._common(blob, blob) == (len(held), len(held)) and research._common(blob, plain) == (len(held), 1) and research._common(plain, blob) == (1, 1)
    assert research._numbers(np.array(["S1", "T1"], object)) is None and research._numbers(np.array(["S1", "S01"], object))[1].tolist() == [11, 101]


def test_time_of_large_cross_sections(spark):
    """Two dates of 40,000 symbols and 252 candidates take less than three plain argsorts of each."""
    n, dates, weights = 40_000, 2, research.weight_grid(spark, 0.2).union(research.weight_grid(spark, 0.2).withColumn("candidate_id", F.col("candidate_id") + 126))
    x = np.random.default_rng(4).normal(size=(n, 1))
    start = time.process_time()
    for _ in range(weights.count() * dates):
        np.argsort(x[:, 0], kind="stable")
    limit = 3 * (time.process_time() - start)
    rows = spark.range(n * dates).select(
        F.expr("date_add(DATE'2025-01-03', CAST(id % 2 AS INT) * 7)").alias("session_date"), F.format_string("S%05d", F.floor(F.col("id") / 2)).alias("symbol"),
        *[F.round(F.randn(i), 9).alias(g) for i, g in enumerate(GROUPS)], F.randn(9).alias("forward_return_20d"), F.expr("TIMESTAMP'2025-02-01 00:00:00'").alias("forward_end_20d"),
    )
    rows = rows.cache()
    rows.count()
    start = time.time()
    got = research.grid_by_dates(rows, weights).toPandas()
    assert len(got) == weights.count() * dates and (got["n"] == n).all() and isinstance(got["rank_ic"].abs().max(), float)
    assert time.time() - start < limit
    assert pd.to_numeric(got["turnover"]).notna().sum() == weights.count()
