"""The same computations as DuckDB SQL over the driver's tables, as chains of common table expressions."""

from __future__ import annotations

from .. import config

W = "OVER (PARTITION BY symbol ORDER BY ts)"


def last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {last(n)} = {n} THEN {agg} {last(n)} END"


SPARSE = """sparse AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), greatest(5, CAST(length(CAST(l_suppkey AS VARCHAR)) AS INTEGER)), '0') AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
         first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

DENSE = f"""{SPARSE}, carried AS (
  SELECT g.symbol, g.ts, s.open, s.high, s.low, s.close, s.volume, last_value(s.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS c
  FROM (SELECT f.symbol, d.ts FROM (SELECT symbol, min(ts) AS f FROM sparse GROUP BY 1) f JOIN (SELECT DISTINCT ts FROM sparse) d ON d.ts >= f.f) g
  LEFT JOIN sparse s ON s.symbol = g.symbol AND s.ts = g.ts
), dense AS (
  SELECT symbol, ts, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, coalesce(close, c) AS close, coalesce(volume, 0.0) AS volume FROM carried)"""

SECURITIES = """securities AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), greatest(5, CAST(length(CAST(s_suppkey AS VARCHAR)) AS INTEGER)), '0') AS symbol, s_name AS name, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def recursive_means() -> str:
    """c3 by the recursion itself, step by step from each symbol's first row."""
    step = lambda e, x, a: f"(1 - {a!r}) * r.{e} + {a!r} * c.{x}"
    means = ", ".join(f"{step(f'e_{n}', 'close', 2 / (n + 1))}" for n in config.EMA_SPANS)
    wilder = ", ".join(f"CASE WHEN c.t = 1 THEN c.{x} ELSE {step(e, x, 1 / 14)} END" for e, x in (("g", "gain"), ("l", "loss")))
    names = ", ".join(f"e_{n}" for n in config.EMA_SPANS)
    return f"""steps AS MATERIALIZED (SELECT symbol, t, close, gain, loss FROM c2
), means AS (SELECT symbol, t, {', '.join(f'close AS e_{n}' for n in config.EMA_SPANS)}, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM steps WHERE t = 0
  UNION ALL SELECT c.symbol, c.t, {means}, {wilder} FROM means r JOIN steps c ON c.symbol = r.symbol AND c.t = r.t + 1
), c3 AS (SELECT c2.*, {names}, g, l FROM c2 JOIN means USING (symbol, t))"""


def core() -> str:
    """CTEs up to `core`, to stand after WITH RECURSIVE."""
    returns = ", ".join(f"close / nullif(lag(close, {n}) {W}, 0) - 1 AS return_{n}d" for n in config.RETURN_WINDOWS)
    year = "sqrt(252.0)"
    emas = ", ".join(f"CASE WHEN t >= {n - 1} THEN e_{n} END AS ema_{n}" for n in config.EMA_SPANS)
    vols = ", ".join(f"{full('stddev_samp(return_1d)', 'return_1d', n)} * {year} AS volatility_{n}d, sqrt({full('avg(down)', 'down', n)}) * {year} AS downside_volatility_{n}d" for n in config.VOLATILITY_WINDOWS)
    to_emas = ", ".join(f"close / nullif(ema_{n}, 0) - 1 AS price_to_ema_{n}" for n in config.EMA_SPANS)
    return f"""{DENSE}, c1 AS (
  SELECT *, row_number() {W} - 1 AS t, lag(close) {W} AS pc, {returns} FROM dense
), c2 AS (
  SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
         CASE WHEN return_1d IS NOT NULL THEN pow(least(return_1d, 0), 2) END AS down,
         CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, close * volume AS dv FROM c1
), {recursive_means()}, c4 AS (
  SELECT *, {emas}, CASE WHEN t >= 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 END ELSE 100 - 100 / (1 + g / l) END END AS rsi_14, {vols},
         close / nullif({full('max(close)', 'close', 60)}, 0) - 1 AS current_drawdown_60d, {full('avg(tr)', 'tr', 14)} AS atr_14,
         {full('quantile_cont(dv, 0.5)', 'dv', 20)} AS median_dollar_volume_20d, volume / nullif({full('avg(volume)', 'volume', 20)}, 0) AS relative_volume_20d FROM c3
), core AS (
  SELECT *, {to_emas}, ema_9 / nullif(ema_21, 0) - 1 AS ema_9_to_21, ema_50 / nullif(ema_200, 0) - 1 AS ema_50_to_200, atr_14 / nullif(close, 0) AS atr_pct_14 FROM c4)"""


def features() -> str:
    baskets = ", ".join(f"round(avg(CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 4 = {i} THEN close END), 4) AS {x}" for i, x in enumerate(("qqq", "tlt", "gld", "schd")))
    labels = {x: x for x in config.PORTFOLIO_REFERENCES} | {"sector": "sector_close"}
    daily = ", ".join(f"{c} / nullif(lag({c}) {W}, 0) - 1 AS r_{x}" for x, c in labels.items())
    excess = ", ".join(f"return_{n}d - ({labels[x]} / nullif(lag({labels[x]}, {n}) {W}, 0) - 1) AS excess_return_{x}_{n}d" for x in ("spy", "sector") for n in (20, 60))
    masked = ", ".join(f"CASE WHEN r_{x} IS NOT NULL THEN return_1d END AS a_{x}, CASE WHEN return_1d IS NOT NULL THEN r_{x} END AS b_{x}" for x in labels)
    corr = ", ".join(f"CASE WHEN count(a_{x}) {last(60)} = 60 THEN covar_samp(a_{x}, b_{x}) {last(60)} / nullif(stddev_samp(a_{x}) {last(60)} * stddev_samp(b_{x}) {last(60)}, 0) END AS corr_{x}_60d" for x in labels)
    return f"""{core()}, {SECURITIES}, bench AS (SELECT ts, round(avg(close), 4) AS spy, {baskets} FROM dense GROUP BY ts
), sector_bench AS (SELECT ts, sector, round(avg(close), 4) AS sector_close FROM dense JOIN securities USING (symbol) GROUP BY ts, sector
), f1 AS (SELECT core.*, securities.sector, bench.* EXCLUDE (ts), sector_close FROM core JOIN securities USING (symbol) LEFT JOIN bench USING (ts) LEFT JOIN sector_bench USING (ts, sector)
), f2 AS (SELECT *, {daily}, {excess} FROM f1), f3 AS (SELECT *, {masked} FROM f2
), features AS (SELECT *, {corr}, CASE WHEN count(a_spy) {last(60)} = 60 THEN covar_samp(a_spy, b_spy) {last(60)} / nullif(var_samp(b_spy) {last(60)}, 0) END AS beta_spy_60d FROM f3)"""


def z_scores(source: str, name: str, columns, by: str, negative=config.NEGATIVE, min_n: int = config.MIN_CROSS_SECTION) -> str:
    xs = f"OVER (PARTITION BY {by})"
    q = ", ".join(f"CASE WHEN count({f}) {xs} >= {min_n} THEN quantile_cont({f}, 0.01) {xs} END AS lo_{f}, CASE WHEN count({f}) {xs} >= {min_n} THEN quantile_cont({f}, 0.99) {xs} END AS hi_{f}" for f in columns)
    c = ", ".join(f"CASE WHEN {f} IS NOT NULL AND lo_{f} IS NOT NULL THEN greatest(least({f}, hi_{f}), lo_{f}) END AS cl_{f}" for f in columns)
    z = ", ".join(f"{-1 if f in negative else 1} * (cl_{f} - avg(cl_{f}) {xs}) / nullif(stddev_pop(cl_{f}) {xs}, 0) AS z_{f}" for f in columns)
    return f"{name}_q AS (SELECT *, {q} FROM {source}), {name}_c AS (SELECT *, {c} FROM {name}_q), {name} AS (SELECT *, {z} FROM {name}_c)"


MISSING = " + ".join(f"CAST({f} IS NULL AS INTEGER)" for f in config.SCORING_FEATURES)
FRIDAY = "CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INTEGER)"


def weekly() -> str:
    labels = ", ".join(f"lead(close, {h}) {W} / nullif(close, 0) - 1 AS forward_return_{h}d, lead(ts, {h}) {W} AS forward_end_{h}d" for h in config.HORIZONS)
    return f"""{features()}, labelled AS (SELECT *, CAST(ts AS DATE) AS session_date, {FRIDAY} AS week, {labels} FROM features
), weekly AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY symbol, week ORDER BY ts DESC) = 1)"""


def panel() -> str:
    groups = ", ".join(f"round(({' + '.join(f'z_{f}' for f in fs)}) / {len(fs)}, 9) AS group_{g}" for g, fs in config.GROUPS.items())
    return f"""{weekly()}, p0 AS (SELECT * FROM weekly QUALIFY count(*) OVER (PARTITION BY session_date) >= {config.MIN_CROSS_SECTION}),
{z_scores('p0', 'p1', config.SCORING_FEATURES, 'session_date')}, panel AS (SELECT *, {groups}, {MISSING} = 0 AS scoring_complete FROM p1)"""


def rank_of(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def signal_daily(source: str, name: str, signal: str, label: str, keys: str = "", end: str | None = None, ties: str = "symbol", min_n: int = config.MIN_CROSS_SECTION) -> str:
    """CTEs that end in `name`: per keys and session_date n, rank_ic, top_bottom_spread, turnover (and label_end)."""
    by = f"{keys + ', ' if keys else ''}session_date"
    order = f"{signal} DESC, symbol" if ties == "symbol" else f"{signal}, symbol"
    a, b = "rn <= k", "rn > n - k"
    top, bottom = (a, b) if ties == "symbol" else (b, a)
    return f"""{name}_1 AS (SELECT *, {signal} AS sig, {label} AS lab, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {signal} IS NOT NULL AND {label} IS NOT NULL
), {name}_2 AS (SELECT *, {rank_of('sig', by)} AS ra, {rank_of('lab', by)} AS rb, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn, greatest(1, CAST(floor(n * 0.2 + 1e-9) AS BIGINT)) AS k FROM {name}_1 WHERE n >= {min_n}
), {name}_3 AS (SELECT {by}, max(n) AS n, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS rank_ic,
  avg(lab) FILTER (WHERE {top}) - avg(lab) FILTER (WHERE {bottom}) AS top_bottom_spread, list(symbol) FILTER (WHERE {top}) AS tops{f', max({end}) AS label_end' if end else ''} FROM {name}_2 GROUP BY {by}
), {name}_4 AS (SELECT *, lag(tops) OVER (PARTITION BY {keys or '1'} ORDER BY session_date) AS before FROM {name}_3
), {name} AS (SELECT * EXCLUDE (tops, before), CASE WHEN before IS NOT NULL THEN 1 - len(list_intersect(tops, before)) / CAST(len(tops) AS DOUBLE) END AS turnover FROM {name}_4)"""


SUMMARY = """avg(rank_ic) AS mean_rank_ic, median(rank_ic) AS median_rank_ic, avg(top_bottom_spread) AS mean_spread, avg(turnover) AS mean_turnover,
avg(CASE WHEN top_bottom_spread > 0 THEN 1.0 ELSE 0.0 END) AS positive_spread_rate, avg(rank_ic) - 0.05 * avg(turnover) AS objective"""
DIAGNOSIS = """count(*) AS dates, avg(rank_ic) AS mean_rank_ic, median(rank_ic) AS median_rank_ic, stddev_pop(rank_ic) AS std_rank_ic,
avg(rank_ic) / nullif(stddev_pop(rank_ic), 0) AS information_ratio, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ic_rate,
avg(top_bottom_spread) AS mean_spread, avg(CASE WHEN top_bottom_spread > 0 THEN 1.0 ELSE 0.0 END) AS positive_spread_rate, avg(turnover) AS mean_turnover"""


def grid(units: int) -> str:
    """candidates: candidate_id and weights in steps of 1 / units."""
    n = f"range({units + 1})"
    return f"""units AS (
  SELECT a, b, c, d, {units} - a - b - c - d AS e FROM (SELECT unnest({n}) AS a), (SELECT unnest({n}) AS b), (SELECT unnest({n}) AS c), (SELECT unnest({n}) AS d) WHERE a + b + c + d <= {units}
), candidates AS (
  SELECT CAST(row_number() OVER (ORDER BY a, b, c, d) - 1 AS INTEGER) AS candidate_id, a / {units}.0::DOUBLE AS w_momentum, b / {units}.0::DOUBLE AS w_trend,
         c / {units}.0::DOUBLE AS w_relative_strength, d / {units}.0::DOUBLE AS w_risk, e / {units}.0::DOUBLE AS w_participation FROM units)"""


SCORE = " + ".join(f"group_{g} * w_{g}" for g in config.GROUPS)


def grid_daily(units: int) -> str:
    complete = " AND ".join(f"group_{g} IS NOT NULL" for g in config.GROUPS)
    return f"""{panel()}, {grid(units)}, scored AS (SELECT p.session_date, p.symbol, forward_return_20d, forward_end_20d, candidate_id, {SCORE} AS score FROM panel p, candidates
  WHERE scoring_complete AND {complete} AND forward_return_20d IS NOT NULL AND forward_end_20d IS NOT NULL),
{signal_daily('scored', 'daily', 'score', 'forward_return_20d', 'candidate_id', 'forward_end_20d', 'stable')}"""


def walk_forward(units: int) -> str:
    metrics = ("mean_rank_ic", "median_rank_ic", "mean_spread", "mean_turnover", "positive_spread_rate", "objective")
    return f"""{grid_daily(units)}, dates AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS no FROM (SELECT DISTINCT session_date FROM daily)
), slots AS (SELECT (no - 52) // 13 AS slot, min(session_date) AS test_start, max(session_date) AS test_end, count(*) AS test_dates FROM dates WHERE no >= 52 GROUP BY 1 HAVING count(*) = 13
), train AS (SELECT * FROM daily JOIN slots ON session_date < test_start AND CAST(label_end AS DATE) < test_start
), folds AS (SELECT slot, train_dates, row_number() OVER (ORDER BY slot) - 1 AS fold FROM (SELECT slot, count(DISTINCT session_date) AS train_dates FROM train GROUP BY slot) WHERE train_dates >= 52
), trained AS (SELECT fold, train_dates, test_start, test_end, test_dates, candidate_id, {SUMMARY} FROM train JOIN folds USING (slot) GROUP BY ALL
), best AS (SELECT fold, train_dates, test_start, test_end, test_dates, candidate_id, {', '.join(f'{m} AS train_{m}' for m in metrics)} FROM trained
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY objective DESC NULLS LAST, mean_rank_ic DESC NULLS LAST, mean_spread DESC NULLS LAST, candidate_id) = 1
), test_daily AS (SELECT b.fold, d.rank_ic, d.top_bottom_spread, CASE WHEN d.session_date > min(d.session_date) OVER (PARTITION BY b.fold) THEN d.turnover END AS turnover
  FROM daily d JOIN best b ON d.candidate_id = b.candidate_id AND d.session_date BETWEEN b.test_start AND b.test_end
), tested AS (SELECT fold, {SUMMARY.replace(' AS ', ' AS test_')} FROM test_daily GROUP BY fold
), walk AS (SELECT * FROM best JOIN tested USING (fold) JOIN candidates USING (candidate_id)
), best_ic AS (SELECT fold, candidate_id FROM trained QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mean_rank_ic DESC NULLS LAST, mean_spread DESC NULLS LAST, candidate_id) = 1)"""
