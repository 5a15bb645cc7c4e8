"""Weight research: candidate grid, daily evaluation, embargoed walk-forward, baselines and signal diagnostics."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..operators.crosssection import composite, metric_summary, percentile_rank, signal_metrics, signal_summary, turnover, winsor_z

GROUP_NAMES = tuple(config.GROUPS)


def weight_grid(spark: SparkSession, step: float = config.WEIGHT_STEP, groups: tuple[str, ...] = GROUP_NAMES) -> DataFrame:
    """(candidate_id, w_<group>...): all weights in steps that add up to 1, numbered in lexicographic order."""
    units = round(1 / step)
    if units < 1 or abs(units * step - 1) > 1e-9:
        raise ValueError("the step must divide 1")
    rows = [(*c, units - sum(c)) for c in itertools.product(range(units + 1), repeat=len(groups) - 1) if sum(c) <= units]
    return spark.createDataFrame([(i, *[u / units for u in r]) for i, r in enumerate(rows)], "candidate_id int, " + ", ".join(f"w_{g} double" for g in groups))


def baseline_weights(spark: SparkSession) -> DataFrame:
    """(model, w_<group>...): equal weights and each group alone."""
    k = len(GROUP_NAMES)
    rows = [("equal_weight", *[1 / k] * k), *[(f"{g}_only", *[1.0 if x == g else 0.0 for x in GROUP_NAMES]) for g in GROUP_NAMES]]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"w_{g} double" for g in GROUP_NAMES))


def scored(panel: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """panel rows for each row of weights, with its composite score. weights is a parameter table of some rows."""
    return panel.crossJoin(F.broadcast(weights.select(key, *[f"w_{g}" for g in GROUP_NAMES]))).withColumn("score", composite({g: F.col(f"w_{g}") for g in GROUP_NAMES}))


def grid_daily(panel: DataFrame, weights: DataFrame, *, label: str = "forward_return_20d", end: str = "forward_end_20d", ties: str = "stable", min_n: int = config.MIN_CROSS_SECTION, share: float = config.BASKET_SHARE) -> DataFrame:
    """(session_date, candidate_id, label_end, rank_ic, top_bottom_spread, turnover, n) by DataFrame operators, for small
    grids: every row meets every candidate."""
    groups = [f"group_{g}" for g in GROUP_NAMES]
    rows = panel.dropna(subset=[*groups, label, end]).select("session_date", "symbol", *groups, label, end)
    return signal_metrics(scored(rows, weights, "candidate_id"), "score", label, keys=("candidate_id",), end=end, ties=ties, min_n=min_n, share=share)


def grid_daily_kernel(panel: DataFrame, weights: DataFrame, *, label: str = "forward_return_20d", end: str = "forward_end_20d", min_n: int = config.MIN_CROSS_SECTION, share: float = config.BASKET_SHARE) -> DataFrame:
    """grid_daily (ties="stable") for large grids: a date's symbols and all candidates meet in one matrix product.

    A date's cross-section goes to one task (a universe's symbols); the matrix is cut into blocks of candidates."""
    groups = [f"group_{g}" for g in GROUP_NAMES]
    table = weights.orderBy("candidate_id").toPandas()  # a parameter table
    w, ids = table[[f"w_{g}" for g in GROUP_NAMES]].to_numpy().T, table["candidate_id"].to_numpy()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol", kind="stable")
        n = len(pdf)
        if n < min_n:
            return pd.DataFrame(columns=["session_date", "candidate_id", "label_end", "n", "rank_ic", "top_bottom_spread", "__top"])
        y, k = pdf[label].to_numpy(), max(1, int(n * share + 1e-9))
        ry = pdf[label].rank().to_numpy()
        ry = ry - ry.mean()
        symbols, x, parts = pdf["symbol"].to_numpy(), pdf[groups].to_numpy(), []
        for i in range(0, len(ids), 256):
            s = x @ w[:, i : i + 256]
            r = pd.DataFrame(s).rank().to_numpy()
            r = r - r.mean(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                ic = (r * ry[:, None]).sum(0) / np.sqrt((r * r).sum(0) * (ry * ry).sum())
            order = np.argsort(s, axis=0, kind="stable")
            top, bottom = order[n - k :], order[:k]
            parts.append(pd.DataFrame({"candidate_id": ids[i : i + 256], "rank_ic": ic, "top_bottom_spread": y[top].mean(0) - y[bottom].mean(0), "__top": list(symbols[top].T)}))
        return pd.concat(parts).assign(session_date=pdf["session_date"].iloc[0], label_end=pdf[end].max(), n=n)[["session_date", "candidate_id", "label_end", "n", "rank_ic", "top_bottom_spread", "__top"]]

    rows = panel.dropna(subset=[*groups, label, end]).select("session_date", "symbol", *groups, label, end)
    daily = rows.groupBy("session_date").applyInPandas(kernel, "session_date date, candidate_id int, label_end timestamp, n long, rank_ic double, top_bottom_spread double, __top array<string>")
    return turnover(daily.withColumn("rank_ic", F.nanvl("rank_ic", F.lit(None).cast("double"))), ("candidate_id",))


#: Days whose cross-sections meet in one task.
SPAN = 56


def _numbers(names: np.ndarray) -> tuple[bytes, np.ndarray] | None:
    """The letter that all names begin with and their digits behind a 1 (S00012: 100012), if they are a letter and digits."""
    letters = {s[:1] for s in names}
    if len(letters) != 1 or not all(1 < len(s) < 18 and s.isascii() and s[1:].isdecimal() and s[0].isalpha() for s in names):
        return None
    return letters.pop().encode(), np.array([int("1" + s[1:]) for s in names], np.int64)


def _packed(names: np.ndarray, numbers: tuple[bytes, np.ndarray] | None, held: np.ndarray) -> bytes:
    """The held ones (places, rising) of names: by the gaps between their numbers where they have any."""
    if numbers is None:
        return b"\0" + zlib.compress("\0".join(names[held]).encode(), 1)
    letter, codes = numbers
    codes = np.sort(codes[held])
    gaps = np.diff(codes)
    gaps = gaps.astype(np.min_scalar_type(gaps.max(initial=0)))
    return letter + bytes([gaps.itemsize]) + codes[:1].tobytes() + zlib.compress(gaps.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    """Numbers of _packed(), or names where it had no numbers."""
    if blob[:1] == b"\0":
        return np.array(zlib.decompress(blob[1:]).decode().split("\0"), object)
    gaps = np.frombuffer(zlib.decompress(blob[10:]), f"u{blob[1]}").astype(np.int64)
    return np.cumsum(np.r_[np.frombuffer(blob[2:10], np.int64), gaps])


def _common(a: bytes, b: bytes) -> tuple[int, int]:
    """How many a holds, and how many of them b holds too."""
    x, y = _unpacked(a), _unpacked(b)
    if a[:1] == b[:1] != b"\0":
        return len(x), len(np.intersect1d(x, y, assume_unique=True))
    named = lambda z, blob: set(z) if z.dtype == object else {blob[:1].decode() + str(c)[1:] for c in z.tolist()}
    return len(x), len(named(x, a) & named(y, b))


@dataclass
class Sorted:
    """A signal without gaps: rows from its smallest value on, equal ones in their own order; same marks those that equal the
    next one (None: nothing is equal)."""

    order: np.ndarray
    same: np.ndarray | None


def _rank_product(s: Sorted, ry: np.ndarray) -> tuple[float, float]:
    """Of the signal's centred average ranks: their product with ry, and their squares' sum. (A BLAS would start threads.)"""
    n = len(s.order)
    ry = ry[s.order]
    if s.same is None:
        return float(np.einsum("i,i", np.arange(n) - (n - 1) / 2, ry)), n * (n * n - 1) / 12
    first = np.flatnonzero(np.r_[True, ~s.same])
    size = np.diff(np.r_[first, n])
    rank = first + (size - 1) / 2 - (n - 1) / 2
    return float(np.einsum("i,i", rank, np.add.reduceat(ry, first))), float(np.einsum("i,i,i", size.astype(float), rank, rank))


def by_dates(rows: DataFrame, keys: str, score: Callable[[object, pd.DataFrame], Iterator[tuple]], *, end: str | None = None, ties: str = "symbol", min_n: int = config.MIN_CROSS_SECTION, share: float = config.BASKET_SHARE) -> DataFrame:
    """signal_metrics() of many signals over large cross-sections: score(date, rows in order of symbols) yields (key values, signal,
    label) and numpy ranks them; a signal may come Sorted (with ties="stable", labels without gaps). A row crosses the network once,
    whatever the number of signals; of baskets only those of a key's first and last dates in a span of days leave a task, for the
    turnover from span to span."""
    names = [k.split()[0] for k in keys.split(", ")]
    kinds = f"{keys}, session_date date, label_end timestamp, n long, rank_ic double, top_bottom_spread double, turnover double"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before = [], {}
        places, symbols = pd.factorize(pdf["symbol"], sort=True)
        symbols = np.asarray(symbols, object)
        numbers, pdf = _numbers(symbols), pdf.assign(__place=places)
        packed = lambda bits: _packed(symbols, numbers, np.flatnonzero(np.unpackbits(bits, count=len(symbols))))
        for date, d in pdf.groupby("session_date"):
            d = d.sort_values("__place", kind="stable")
            place, ranked = d["__place"].to_numpy(), {}
            for key, v, y in score(date, d):
                whole = isinstance(v, Sorted)
                there = slice(None) if whole else ~(np.isnan(v) | np.isnan(y))
                n = len(y) if whole else int(there.sum())
                if n < min_n:
                    continue
                k = max(1, int(n * share + 1e-9))
                same = (id(y), None if whole else there.tobytes())
                if same not in ranked:
                    own = y[there]
                    ry = _ranks(own, np.argsort(own, kind="stable"))
                    ranked[same] = y, own, ry, float(((ry - ry.mean()) ** 2).sum()), d[end].to_numpy()[there].max() if end else None, place[there]
                _, y, ry, squares, ended, own_place = ranked[same]
                if whole:
                    order = v.order
                    product, own_squares = _rank_product(v, ry)
                else:
                    v = v[there]
                    order = np.argsort(v if ties == "stable" else -v, kind="stable")
                    rv = _ranks(v, order) * (1 if ties == "stable" else -1)
                    a, b = rv - rv.mean(), ry - ry.mean()
                    product, own_squares = (a * b).sum(), (a * a).sum()
                scale = math.sqrt(own_squares * squares)
                top, bottom = (order[n - k :], order[:k]) if ties == "stable" else (order[:k], order[n - k :])
                held = np.zeros(len(symbols), bool)
                held[own_place[top]] = True
                held, old = np.packbits(held), before.get(key)
                turned = None if old is None else 1 - int(np.bitwise_count(held & old[0]).sum()) / k
                row = [*key, date, ended, n, product / scale if scale else None, y[top].mean() - y[bottom].mean(), turned, packed(held) if old is None else None, None]
                out.append(row)
                before[key] = held, row
        for held, row in before.values():
            row[-1] = packed(held)
        return pd.DataFrame(out, columns=[*names, "session_date", "label_end", "n", "rank_ic", "top_bottom_spread", "turnover", "__first", "__last"])

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_date", kind="stable").reset_index(drop=True)
        firsts, lasts, turned = pdf["__first"], pdf["__last"], pdf["turnover"].to_numpy(float, copy=True)
        for i in range(1, len(pdf)):
            if firsts[i] is not None:
                k, both = _common(firsts[i], lasts[i - 1])
                turned[i] = 1 - both / k
        return pdf.assign(turnover=turned).drop(columns=["__first", "__last"])

    spans = rows.withColumn("__span", F.floor(F.unix_date("session_date") / SPAN)).groupBy("__span").applyInPandas(lambda pdf: kernel(pdf), f"{kinds}, __first binary, __last binary")
    daily = spans.groupBy(*names).applyInPandas(stitch, kinds)
    none = F.lit(None).cast("double")
    daily = daily.withColumns({c: F.nanvl(c, none) for c in ("rank_ic", "turnover")})
    return daily if end else daily.drop("label_end")


def _ranks(v: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of v along order, equal values sharing their mean."""
    sorted_ = v[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    size = np.diff(np.r_[first, len(v)])
    out = np.empty(len(v))
    out[order] = np.repeat(first + (size - 1) / 2, size)
    return out


def weighted(d: pd.DataFrame, weights) -> np.ndarray:
    """composite() of a date's rows."""
    return _weighted([d[f"group_{g}"].to_numpy() for g in GROUP_NAMES], weights)


def _weighted(groups: list[np.ndarray], weights) -> np.ndarray:
    terms = [x * w for x, w in zip(groups, weights)]
    return sum(terms[1:], terms[0])


#: Group scores have so many digits; weights are parts of 1 of at most so many.
DIGITS, PARTS = 9, 1000


def _units(weights: list[list[float]]) -> tuple[int, np.ndarray] | None:
    """The number of parts of 1 that all weights are whole multiples of, and the multiples."""
    w = np.array(weights, float)
    for parts in range(1, PARTS + 1):
        if len(w) and (np.abs(w * parts - np.rint(w * parts)) < 1e-9).all():
            return parts, np.rint(w * parts).astype(np.int64)
    return None


def grid_orders(groups: list[np.ndarray], weights: list[list[float]], units: tuple[int, np.ndarray] | None) -> Iterator[Sorted | np.ndarray]:
    """For each row of weights the order of its composite score, which is _weighted()'s, last bits of equal sums included.

    Scores of some digits and weights of some parts add up to whole numbers: with a row's place behind them they are sorted as
    integers, several times faster than an argsort, and a candidate's sums follow from the one before. Rows of equal sums but other
    group scores are told apart by their floating sums. What isn't whole, or too large, comes as plain scores."""
    n, ten = len(groups[0]), 10.0**DIGITS
    whole = [np.rint(x * ten) for x in groups]
    bits = max(1, (n - 1).bit_length())
    most = sum(float(np.abs(w).max(initial=0)) for w in whole) * (float(np.abs(units[1]).max(initial=0)) if units else math.inf)
    # the floating sums' errors have to stay far below one unit
    if not (most < 2.0 ** (62 - bits) and most * 32 * np.finfo(float).eps < 0.5 and all((w / ten == x).all() for w, x in zip(whole, groups))):
        for w in weights:
            yield _weighted(groups, w)
        return
    shifted, key, now, kind = [w.astype(np.int64) << bits for w in whole], np.arange(n), [0] * len(groups), None
    for w, mine in zip(weights, units[1].tolist()):
        for x, old, new in zip(shifted, now, mine):
            if abs(new - old) > 1:
                key += x * (new - old)
            elif new != old:
                (np.add if new > old else np.subtract)(key, x, out=key)
        now = mine
        total = np.sort(key)
        order = total & ((1 << bits) - 1)
        total >>= bits
        same = total[1:] == total[:-1]
        if not same.any():
            yield Sorted(order, None)
            continue
        if kind is None:
            kind = _kinds(whole)
        own = kind[order]
        other = same & (own[1:] != own[:-1])
        if other.any():
            run = np.r_[0, np.cumsum(~same)]
            at = np.flatnonzero(np.isin(run, run[:-1][other]))
            rows, run = order[at], run[at]
            score = _weighted([x[rows] for x in groups], w)
            o = np.lexsort((score, run))
            order[at], score = rows[o], score[o]
            same[at[:-1]] = (run[1:] == run[:-1]) & (score[1:] == score[:-1])
        yield Sorted(order, same)


def _kinds(columns: list[np.ndarray]) -> np.ndarray:
    """Equal numbers for rows that are equal in all columns."""
    o = np.lexsort(columns)
    new = np.logical_or.reduce([x[o][1:] != x[o][:-1] for x in columns])
    out = np.empty(len(o), np.int32)
    out[o] = np.r_[0, np.cumsum(new)]
    return out


def grid_by_dates(panel: DataFrame, weights: DataFrame, *, label: str = "forward_return_20d", end: str = "forward_end_20d") -> DataFrame:
    """grid_daily() for any number of symbols and candidates."""
    groups = [f"group_{g}" for g in GROUP_NAMES]
    table = [(r["candidate_id"], [r[f"w_{g}"] for g in GROUP_NAMES]) for r in weights.orderBy("candidate_id").collect()]  # a parameter table
    ws = [w for _, w in table]
    units = _units(ws)

    def score(date, d):
        y = d[label].to_numpy()
        for (i, _), v in zip(table, grid_orders([d[g].to_numpy() for g in groups], ws, units)):
            yield (i,), v, y

    rows = panel.dropna(subset=[*groups, label, end]).select("session_date", "symbol", *groups, label, F.col(end).cast("timestamp").alias(end))
    return by_dates(rows, "candidate_id int", score, end=end, ties="stable")


def diagnose_by_dates(panel: DataFrame, signals: dict[str, str], name: str = "signal", *, folds: list[tuple] | None = None, horizons: tuple[int, ...] = config.HORIZONS) -> DataFrame:
    """diagnose() for any number of symbols: signals maps names to columns; with folds (fold, first and last date) in each of them."""

    def score(date, d):
        inside = [(f,) for f, a, b in folds if a <= date <= b] if folds is not None else [()]
        labels = {h: d[f"forward_return_{h}d"].to_numpy() for h in horizons}
        for s, c in signals.items() if inside else ():
            v = np.round(d[c].to_numpy(), 9)
            for h, y in labels.items():
                for f in inside:
                    yield (*f, s, h), v, y

    keys = ("fold long, " if folds is not None else "") + f"{name} string, horizon int"
    rows = panel.select("session_date", "symbol", *dict.fromkeys([*signals.values(), *[f"forward_return_{h}d" for h in horizons]]))
    return signal_summary(by_dates(rows, keys, score), *[k.split()[0] for k in keys.split(", ")])


def baseline_by_dates(panel: DataFrame, folds: DataFrame, models: DataFrame, optimized: DataFrame, *, label: str = "forward_return_20d") -> DataFrame:
    """baseline_comparison() for any number of symbols: folds and weights are parameter tables."""
    ws = [f"w_{g}" for g in GROUP_NAMES]
    fixed = [(r["model"], [r[w] for w in ws]) for r in models.collect()]
    windows = [(r["fold"], r["test_start"], r["test_end"]) for r in folds.select("fold", "test_start", "test_end").collect()]
    own: dict[int, list] = {}
    for r in optimized.collect():
        own.setdefault(r["fold"], []).append((r["model"], [r[w] for w in ws]))

    def score(date, d):
        y = d[label].to_numpy()
        for f, a, b in windows:
            if a <= date <= b:
                for m, w in [*fixed, *own.get(f, [])]:
                    yield (f, m), weighted(d, w), y

    rows = panel.filter(F.col("scoring_complete") & F.col(label).isNotNull()).select("session_date", "symbol", *[f"group_{g}" for g in GROUP_NAMES], label)
    if windows:
        rows = rows.filter(F.col("session_date").between(min(a for _, a, _ in windows), max(b for _, _, b in windows)))
    return metric_summary(by_dates(rows, "fold long, model string", score), "fold", "model")


def fold_schedule(daily: DataFrame, *, start: int = config.MIN_TRAINING_DATES, test: int = config.TEST_DATES) -> DataFrame:
    """(slot, test_start, test_end): windows of `test` scoring dates from the start-th on; a partial last one is left out.
    The window runs over a row per date."""
    dates = daily.select("session_date").distinct().withColumn("no", F.row_number().over(Window.orderBy("session_date")) - 1)
    slots = dates.filter(F.col("no") >= start).withColumn("slot", F.floor((F.col("no") - start) / test))
    slots = slots.groupBy("slot").agg(F.min("session_date").alias("test_start"), F.max("session_date").alias("test_end"), F.count(F.lit(1)).alias("test_dates"))
    return slots.filter(F.col("test_dates") == test)


def training_rows(daily: DataFrame, schedule: DataFrame) -> DataFrame:
    """Daily rows that each slot may learn from: scored, and their label ended, before the test starts."""
    return daily.join(F.broadcast(schedule), (F.col("session_date") < F.col("test_start")) & (F.to_date("label_end") < F.col("test_start")))


def fold_table(daily: DataFrame, schedule: DataFrame, *, min_dates: int = config.MIN_TRAINING_DATES) -> DataFrame:
    """schedule's slots with at least min_dates training dates, numbered as folds: (slot, fold, train_dates)."""
    counts = training_rows(daily, schedule).groupBy("slot").agg(F.count_distinct("session_date").alias("train_dates")).filter(F.col("train_dates") >= min_dates)
    return counts.withColumn("fold", F.row_number().over(Window.orderBy("slot")) - 1)


def walk_forward(daily: DataFrame, weights: DataFrame, *, start: int = config.MIN_TRAINING_DATES, test: int = config.TEST_DATES, min_dates: int = config.MIN_TRAINING_DATES, order: tuple[str, ...] = ("objective", "mean_rank_ic", "mean_spread")) -> DataFrame:
    """A row per fold: the best candidate of the training dates, its weights, and its train_ and test_ metrics.

    The grid's turnover carries membership through the whole history; a test window's first one is left out."""
    schedule = fold_schedule(daily, start=start, test=test)
    folds = fold_table(daily, schedule, min_dates=min_dates)
    trained = metric_summary(training_rows(daily, schedule).join(F.broadcast(folds.select("slot", "fold", "train_dates")), "slot"), "fold", "slot", "train_dates", "test_start", "test_end", "test_dates", "candidate_id")
    first = Window.partitionBy("fold").orderBy(*[F.desc_nulls_last(c) for c in order], F.asc("candidate_id"))
    metrics = ["mean_rank_ic", "median_rank_ic", "mean_spread", "mean_turnover", "positive_spread_rate", "objective"]
    best = trained.withColumn("no", F.row_number().over(first)).filter("no = 1").drop("no").withColumnsRenamed({m: f"train_{m}" for m in metrics})
    tested = daily.join(F.broadcast(best.select("fold", "candidate_id", "test_start", "test_end")), "candidate_id").filter(F.col("session_date").between(F.col("test_start"), F.col("test_end")))
    tested = tested.withColumn("turnover", F.when(F.col("session_date") > F.min("session_date").over(Window.partitionBy("fold")), F.col("turnover")))
    tested = metric_summary(tested, "fold").withColumnsRenamed({m: f"test_{m}" for m in metrics})
    return best.join(tested, "fold").join(F.broadcast(weights), "candidate_id").drop("slot")


def walk_forward_summary(walk: DataFrame) -> DataFrame:
    """One row: folds, and the means over them of the out-of-sample metrics and of the chosen weights."""
    means = ["test_mean_rank_ic", "test_median_rank_ic", "test_mean_spread", "test_mean_turnover", "test_positive_spread_rate", "test_objective", *[f"w_{g}" for g in GROUP_NAMES]]
    return walk.agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(m) for m in means])


def optimized_weights(penalized: DataFrame, ic_only: DataFrame) -> DataFrame:
    """(fold, model, w_<group>...): the weights that walk_forward chose in each fold, by its objective and by rank IC alone."""
    ws = [f"w_{g}" for g in GROUP_NAMES]
    parts = [df.select("fold", F.lit(f"optimized_{name}").alias("model"), *ws) for name, df in (("penalized", penalized), ("ic_only", ic_only))]
    return parts[0].unionByName(parts[1])


def baseline_comparison(panel: DataFrame, folds: DataFrame, models: DataFrame, optimized: DataFrame | None = None, *, label: str = "forward_return_20d", min_n: int = config.MIN_CROSS_SECTION) -> DataFrame:
    """metric_summary of each model (model, w_...) in each fold's test window (fold, test_start, test_end).

    optimized holds models whose weights are a fold's own (fold, model, w_...)."""
    rows = panel.filter(F.col("scoring_complete") & F.col(label).isNotNull()).select("session_date", "symbol", *[f"group_{g}" for g in GROUP_NAMES], label)
    rows = rows.join(F.broadcast(folds.select("fold", "test_start", "test_end")), F.col("session_date").between(F.col("test_start"), F.col("test_end")))
    both = scored(rows, models, "model")
    if optimized is not None:
        own = rows.join(F.broadcast(optimized.select("fold", "model", *[f"w_{g}" for g in GROUP_NAMES])), "fold")
        both = both.unionByName(own.withColumn("score", composite({g: F.col(f"w_{g}") for g in GROUP_NAMES})))
    daily = signal_metrics(both, "score", label, keys=("fold", "model"), min_n=min_n)
    return metric_summary(daily, "fold", "model")


def baseline_summary(comparison: DataFrame) -> DataFrame:
    """Per model over its folds."""
    return comparison.groupBy("model").agg(
        F.count_distinct("fold").alias("folds"), F.avg("mean_rank_ic").alias("mean_rank_ic"), F.median("mean_rank_ic").alias("median_fold_rank_ic"), F.avg("median_rank_ic").alias("mean_fold_median_rank_ic"),
        F.avg("mean_spread").alias("mean_spread"), F.avg("positive_spread_rate").alias("mean_positive_spread_rate"), F.avg("mean_turnover").alias("mean_turnover"),
        F.avg(F.when(F.col("mean_rank_ic") > 0, 1.0).otherwise(0.0)).alias("positive_ic_fold_rate"),
    )


def diagnose(panel: DataFrame, signals: list[str], *, horizons: tuple[int, ...] = config.HORIZONS, min_n: int = config.MIN_CROSS_SECTION) -> DataFrame:
    """signal_summary of every signal against every horizon, in one pass over an unpivoted panel."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon"), F.col(s).alias("value"), F.col(f"forward_return_{h}d").alias("label")) for s in signals for h in horizons]))
    long = panel.select("session_date", "symbol", pairs.alias("e")).select("session_date", "symbol", "e.*")
    return signal_summary(signal_metrics(long, "value", "label", keys=("signal", "horizon"), min_n=min_n), "signal", "horizon")


def momentum_signals(panel: DataFrame, *, min_n: int = config.MIN_CROSS_SECTION) -> DataFrame:
    """Long returns without the last month, standardised: momentum_{252,126}d_ex_20d."""
    ex = {f"momentum_{n}d_ex_20d": (1 + F.col(f"return_{n}d")) / F.nullif(1 + F.col("return_20d"), F.lit(0.0)) - 1 for n in (252, 126)}
    return winsor_z(panel.withColumns(ex), list(ex), min_n=min_n, negative=())


def compact_candidates(panel: DataFrame) -> DataFrame:
    """panel with the study's four candidates as percentile ranks by date: two momenta, the slow trend, and the blend
    (mean of the ranks of the momentum without the last month and of the trend)."""
    momentum = (1 + F.col("return_252d")) / F.nullif(1 + F.col("return_20d"), F.lit(0.0)) - 1
    raw = {"return_252d": F.col("return_252d"), "momentum_252d_ex_20d": momentum, "ema_50_to_200": F.col("ema_50_to_200")}
    df = panel.withColumns({f"__v_{n}": F.round(x, 9) for n, x in raw.items()})  # last bits don't decide ties
    df = df.withColumns({f"rank_{n}": percentile_rank(f"__v_{n}", "session_date") for n in raw}).drop(*[f"__v_{n}" for n in raw])
    return df.withColumn("compact_alpha_blend", (F.col("rank_momentum_252d_ex_20d") + F.col("rank_ema_50_to_200")) / 2)


#: The study's names of the candidates, and their columns in compact_candidates().
COMPACT_CANDIDATES = {
    "return_252d": "rank_return_252d",
    "momentum_252d_ex_20d": "rank_momentum_252d_ex_20d",
    "ema_50_to_200": "rank_ema_50_to_200",
    "momentum_12_1_plus_slow_trend": "compact_alpha_blend",
}


def compact_study(candidates: DataFrame, folds: DataFrame, *, horizons: tuple[int, ...] = config.HORIZONS, min_n: int = config.MIN_CROSS_SECTION) -> DataFrame:
    """signal_summary of every candidate against every horizon in each fold's test window."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(h).alias("horizon"), F.round(c, 9).alias("value"), F.col(f"forward_return_{h}d").alias("label")) for n, c in COMPACT_CANDIDATES.items() for h in horizons]))
    long = candidates.select("session_date", "symbol", pairs.alias("e")).select("session_date", "symbol", "e.*")
    rows = long.join(F.broadcast(folds.select("fold", "test_start", "test_end")), F.col("session_date").between(F.col("test_start"), F.col("test_end")))
    return signal_summary(signal_metrics(rows, "value", "label", keys=("fold", "candidate", "horizon"), min_n=min_n), "fold", "candidate", "horizon")


def compact_study_summary(study: DataFrame) -> DataFrame:
    """Per horizon and candidate over its folds."""
    means = ("mean_rank_ic", "median_rank_ic", "positive_ic_rate", "mean_spread", "positive_spread_rate")
    return study.groupBy("horizon", "candidate").agg(F.count_distinct("fold").alias("folds"), *[F.avg(m).alias(m) for m in means])
