"""Registered queries over the order tables, and the same in SQL for DuckDB.

Doubles are rounded to six digits on both sides, since sums and logarithms differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import DEVIATIONS, RAISED, RATIO, gauss_legendre
from panelscope.operators import backtest, benchmarks, blocks, comparison, coverage, detectors, events, features, gaussian, momentum, online, training
from panelscope.operators import panel as shapes
from panelscope.plans import market
from panelscope.schema import COUNTRY_REGION, EXCHANGE_COUNTRY, HORIZONS, VOL_WINDOWS

#: Parameters of the comparison of detectors (fixed values).
CUSUM, JUMP, TTEST = (60, 4.0, 30), (40, 2.5, 30), (20, 0.01, 30)
TOLERANCE = 20
METHODS = ["cusum", "jump", "ttest"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six digits, but for prices of the panel, which are exact."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) if kind == "double" and (c != "price" or "benchmark" in df.columns or len(df.columns) == 2) else F.col(f"`{c}`") for c, kind in df.dtypes])


def values(rows, columns: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(VALUES {quoted}) AS v({columns})"


PANEL = f"""
names AS (
  SELECT s_suppkey, concat('S', s_suppkey, ' ', list_extract([{", ".join(f"'{s}'" for s in market.SUFFIXES)}], s_nationkey % {len(market.SUFFIXES)} + 1)) AS ticker
  FROM supplier),
panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, ticker,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price
  FROM lineitem JOIN names ON l_suppkey = s_suppkey GROUP BY ALL)"""
CALM = PANEL.replace("panel AS", "noisy AS") + f", panel AS (SELECT date, ticker, price + {market.LEVEL} AS price FROM noisy)"
WIN = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def lagged(kind: str, n: int) -> str:
    if kind == "log":
        return f"ln(price) - ln(lag(price, {n}) OVER w)"
    return f"price / nullif(lag(price, {n}) OVER w, 0) - 1"


LOGS = ", ".join(f'round({lagged("log", n)}, 6) AS "{name}_log_ret"' for n, name in HORIZONS)
ARITHS = ", ".join(f'round({lagged("arith", n)}, 6) AS "{name}_arith_ret"' for n, name in HORIZONS)
VOLS = ", ".join(
    f'round(CASE WHEN count(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} '
    f'THEN stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) * sqrt(252.0) END, 6) AS "{name}_vol"'
    for n, name in VOL_WINDOWS
)
DAILY = f"daily AS (SELECT *, {lagged('log', 1)} AS lr FROM panel {WIN})"
ENRICHED = f"""
enriched AS (
  SELECT p.*, regexp_extract(ticker, '(\\S+)\\s*$', 1) AS exchange, c.country, r.region
  FROM panel p LEFT JOIN {values(EXCHANGE_COUNTRY, 'exchange, country').replace(' AS v(', ' AS c(')} ON regexp_extract(p.ticker, '(\\S+)\\s*$', 1) = c.exchange
  LEFT JOIN {values(COUNTRY_REGION, 'country, region').replace(' AS v(', ' AS r(')} ON c.country = r.country)"""
STACK = f"""
r AS (SELECT *, {lagged('arith', 1)} AS r, row_number() OVER w = 1 AS starts FROM panel {WIN}),
ew_daily AS (SELECT date, sum(r) AS total, count(*) FILTER (starts) AS starts FROM r GROUP BY date),
ew_ret AS (SELECT date, coalesce(total, 0) / nullif(coalesce(sum(starts) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS ret FROM ew_daily),
ew AS (SELECT date, CASE WHEN row_number() OVER (ORDER BY date) = 1 THEN 100.0
       WHEN ret IS NOT NULL THEN 100 * product(1 + ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS price FROM ew_ret),
given AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) + {market.LEVEL} AS price FROM lineitem GROUP BY 1),
wide AS (SELECT g.date, g.price AS SXXR, e.price AS EW FROM given g JOIN ew e USING (date) WHERE g.price IS NOT NULL AND e.price IS NOT NULL),
based AS (SELECT date, 100 * SXXR / first_value(SXXR) OVER (ORDER BY date) AS SXXR, 100 * EW / first_value(EW) OVER (ORDER BY date) AS EW FROM wide),
levels AS (SELECT date, 'SXXR' AS benchmark, SXXR AS level FROM based UNION ALL SELECT date, 'EW', EW FROM based),
dd AS (SELECT *, level / max(level) OVER (PARTITION BY benchmark ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
       level / lag(level) OVER (PARTITION BY benchmark ORDER BY date) - 1 AS r FROM levels)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


@query(
    f"""SELECT CAST(l_shipdate AS DATE) AS date, concat('ALL ', list_extract([{", ".join(f"'{s}'" for s in market.SUFFIXES)}], s_nationkey % {len(market.SUFFIXES)} + 1)) AS ticker,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide matrix of one column for each exchange, made long."""
    return r6(shapes.wide_to_long(market.wide(spark, sf_dir)))


@query(with_(PANEL) + "SELECT date, ticker, price FROM panel ORDER BY date, ticker LIMIT 5")
def panel_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, as a look at the panel."""
    return r6(market.panel(spark, sf_dir).orderBy("date", "ticker").limit(5))


@query(with_(PANEL) + f"SELECT date, ticker, price FROM panel WHERE split_part(ticker, ' ', 1) IN ({', '.join(repr(n) for n in market.ANALYSED)})")
def analysed_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a list of tickers."""
    return r6(market.panel(spark, sf_dir).where(F.split("ticker", " ")[0].isin(*market.ANALYSED)))


@query(with_(PANEL) + f"SELECT date, ticker, {LOGS} FROM panel {WIN}")
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.add_log_returns(market.panel(spark, sf_dir)).drop("price"))


@query(with_(PANEL) + f"SELECT date, ticker, {ARITHS} FROM panel {WIN}")
def arith_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.add_arith_returns(market.panel(spark, sf_dir)).drop("price"))


@query(with_(PANEL, DAILY) + f"SELECT date, ticker, {VOLS} FROM daily")
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.add_realized_vol(market.panel(spark, sf_dir)).drop("price"))


@query(with_(PANEL, ENRICHED, DAILY.replace("FROM panel", "FROM enriched")) + f"SELECT date, ticker, price, {LOGS}, {ARITHS}, {VOLS}, exchange, country, region FROM daily {WIN}")
def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(shapes.finalize(shapes.add_country_region(features.add_features(market.panel(spark, sf_dir)))))


@query(with_(PANEL, ENRICHED) + "SELECT ticker, exchange, country, region, count(*) AS n_rows FROM enriched GROUP BY ALL")
def country_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.add_country_region(market.panel(spark, sf_dir)).groupBy("ticker", "exchange", "country", "region").agg(F.count("*").alias("n_rows"))


for _column in ("country", "region"):

    def _tickers_by(spark: SparkSession, sf_dir: str, column: str = _column) -> DataFrame:
        return coverage.tickers_by(shapes.add_country_region(market.panel(spark, sf_dir)), column)

    _tickers_by.__name__ = f"tickers_by_{_column}"
    query(with_(PANEL, ENRICHED) + f"SELECT {_column}, count(DISTINCT ticker) AS n_tickers FROM enriched WHERE {_column} IS NOT NULL GROUP BY 1")(_tickers_by)


@query(with_(PANEL) + "SELECT ticker, count(date) AS n_obs FROM panel GROUP BY 1")
def ticker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(market.panel(spark, sf_dir))


@query(
    with_(PANEL, "c AS (SELECT ticker, count(date) AS n_obs FROM panel GROUP BY 1)", "d AS (SELECT count(DISTINCT date) AS n_dates FROM panel)")
    + "SELECT min(n_obs) AS min_obs, CAST(floor(median(n_obs)) AS BIGINT) AS median_obs, max(n_obs) AS max_obs, count(*) FILTER (n_obs = n_dates) AS full_history, count(*) AS n_tickers, max(n_dates) AS n_dates FROM c, d"
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_summary(market.panel(spark, sf_dir))


@query(with_(PANEL) + "SELECT date, round(count(DISTINCT ticker) / (SELECT count(DISTINCT ticker) FROM panel), 6) AS fraction FROM panel GROUP BY 1")
def alive_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(coverage.alive_fraction(market.panel(spark, sf_dir)))


@query(with_(PANEL) + "SELECT round(1 - count(price) / (count(DISTINCT date) * count(DISTINCT ticker)), 6) AS nan_fraction FROM panel")
def nan_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(coverage.nan_fraction(market.panel(spark, sf_dir)))


@query(with_(PANEL) + "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date FROM panel")
def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.panel_summary(market.panel(spark, sf_dir))


@query(
    with_(PANEL, f"x AS (SELECT greatest(-0.2, least(0.2, round({lagged('arith', 1)}, 6))) AS x, {lagged('arith', 1)} AS raw FROM panel {WIN})", "e AS (SELECT min(x) AS lo, max(x) AS hi FROM x WHERE raw IS NOT NULL)")
    + "SELECT CAST(least(floor((x - lo) * 200 / (hi - lo)), 199) AS INTEGER) AS bin, count(*) AS n FROM x, e WHERE raw IS NOT NULL GROUP BY 1"
)
def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = market.panel(spark, sf_dir).select(F.round(features.arith_return(1), 6).alias("r"))
    return coverage.histogram(daily, "r")


@query(with_(CALM, STACK) + "SELECT date, round(ret, 6) + 0.0 AS ret FROM ew_ret")
def ew_return_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(benchmarks.equal_weight_returns(market.calm(spark, sf_dir)))


@query(
    with_(PANEL, "days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM panel))", f"x AS (SELECT date, day - lag(day) OVER w AS gap, {lagged('arith', 1)} AS r FROM panel JOIN days USING (date) {WIN})")
    + "SELECT date, round(avg(CASE WHEN gap = 1 THEN r END), 6) AS ret FROM x GROUP BY 1"
)
def ew_return_nofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(benchmarks.equal_weight_returns(market.panel(spark, sf_dir), "none"))


@query(with_(CALM, STACK) + "SELECT date, round(price, 6) AS price FROM ew")
def ew_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(benchmarks.equal_weight_index(market.calm(spark, sf_dir)))


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.stacked(market.benchmark(spark, sf_dir), benchmarks.equal_weight_index(market.calm(spark, sf_dir)))


@query(with_(CALM, STACK) + "SELECT date, 'SXXR' AS benchmark, round(price, 6) AS price FROM given UNION ALL SELECT date, 'EW', round(price, 6) FROM ew")
def benchmark_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_stack(spark, sf_dir))


@query(with_(CALM, STACK) + "SELECT date, round(SXXR, 6) AS SXXR, round(EW, 6) AS EW FROM wide")
def benchmark_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(benchmarks.side_by_side(_stack(spark, sf_dir)))


@query(with_(CALM, STACK) + "SELECT date, round(SXXR, 6) AS SXXR, round(EW, 6) AS EW FROM based")
def benchmark_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(benchmarks.rebased(_stack(spark, sf_dir)))


@query(
    with_(CALM, STACK, "s AS (SELECT benchmark, avg(r) AS m, stddev_samp(r) * sqrt(252.0) AS vol, min(drawdown) AS low FROM dd GROUP BY 1)")
    + "SELECT benchmark, round_even((pow(1 + m, 252) - 1) * 100, 2) AS cagr_pct, round_even(vol * 100, 2) AS vol_pct, round_even((pow(1 + m, 252) - 1) / vol, 2) AS sharpe, round_even(low * 100, 2) AS max_dd_pct FROM s"
)
def benchmark_risk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.risk_stats(_stack(spark, sf_dir))


@query(with_(CALM, STACK) + "SELECT date, benchmark, round(level, 6) AS level, round(drawdown, 6) AS drawdown FROM dd")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(benchmarks.drawdowns(_stack(spark, sf_dir)))


@query(with_(PANEL) + "SELECT date, ticker, price FROM panel WHERE ticker LIKE 'S1 %'")
def single_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(market.panel(spark, sf_dir).where(F.col("ticker").startswith("S1 ")).orderBy("date"))


@query(with_(PANEL) + f"SELECT date, ticker, price, round(100 * price / first_value(price) OVER w, 6) AS level FROM panel {WIN}")
def rebase_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(benchmarks.rebased_first_valid(market.panel(spark, sf_dir)))


RETURNS = f"ret AS (SELECT ticker, CAST(row_number() OVER w - 2 AS INTEGER) AS t, date, {lagged('arith', 1)} AS r FROM panel {WIN} QUALIFY t >= 0)"


def z_cte(name: str, n: int) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""{name} AS (SELECT ticker, t, mu, sigma, CASE WHEN sigma >= 1e-12 THEN (r - mu) / sigma END AS z
  FROM (SELECT *, avg(r) {frame} AS mu, stddev_samp(r) {frame} AS sigma FROM ret) WHERE t >= {n})"""


def cooled_cte(name: str, candidates: str, cooldown: int) -> str:
    return f"""{name}_lists AS (SELECT ticker, list_sort(list(t)) AS ts FROM {candidates} GROUP BY 1),
{name}_steps AS (
  SELECT ticker, ts, ts[1] AS t FROM {name}_lists
  UNION ALL SELECT ticker, ts, list_filter(ts, lambda x: x - t > {cooldown})[1] FROM {name}_steps WHERE len(list_filter(ts, lambda x: x - t > {cooldown})) > 0),
{name} AS (SELECT ticker, t FROM {name}_steps)"""


def cusum_cte(name: str, n: int, threshold: float, cooldown: int) -> str:
    return f"""{z_cte(name + '_z', n)},
{name}_n AS (SELECT ticker, t, z, row_number() OVER (PARTITION BY ticker ORDER BY t) AS k FROM {name}_z WHERE z IS NOT NULL),
{name}_lists AS (SELECT ticker, list(t ORDER BY k) AS ts, list(z ORDER BY k) AS zs FROM {name}_n GROUP BY 1),
{name}_steps AS (
  SELECT ticker, ts, zs, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST({-cooldown - 1} AS INTEGER) AS last, false AS hit FROM {name}_lists
  UNION ALL
  SELECT ticker, ts, zs, k, CASE WHEN hit THEN 0 ELSE up END, CASE WHEN hit THEN 0 ELSE down END, CASE WHEN hit THEN ts[k] ELSE last END, hit FROM (
    SELECT *, greatest(up, down) > {threshold} AND ts[k] - last > {cooldown} AS hit FROM (
      SELECT ticker, ts, zs, k + 1 AS k, greatest(0, up + zs[k + 1] - 0.5) AS up, greatest(0, down - zs[k + 1] - 0.5) AS down, last
      FROM {name}_steps WHERE k < len(ts)) a) b),
{name} AS (SELECT ticker, ts[k] AS t FROM {name}_steps WHERE hit)"""


def p_value(dof: str) -> str:
    """From the columns angle and length; see student_t_two_sided()."""
    tail = " + ".join(f"{w!r} * pow(cos(angle + length * {x!r}), {dof} - 1)" for x, w in gauss_legendre())
    raised = f"({dof} / 2 + {RAISED})"
    series = "0.0"
    for c in reversed(RATIO):
        series = f"({series} / {raised} + {c!r})"
    rising = " * ".join(f"(({dof} / 2 + {k + 0.5}) / ({dof} / 2 + {k}))" for k in range(RAISED))
    return f"({tail}) * length / (sqrt(pi()) / 2 * {series} / sqrt({raised}) * {rising})"


def welch_cte(name: str, n: int) -> str:
    far = f"OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {2 * n} PRECEDING AND {n + 1} PRECEDING)"
    near = f"OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""{name}_m AS (SELECT ticker, t, avg(r) {far} AS ma, var_samp(r) {far} / {n} AS va, avg(r) {near} AS mb, var_samp(r) {near} / {n} AS vb FROM ret),
{name}_t AS (SELECT ticker, t, ma, mb, va, vb, (ma - mb) / nullif(sqrt(va + vb), 0) AS t_stat, (va + vb) * (va + vb) / nullif((va * va + vb * vb) / {n - 1}, 0) AS dof FROM {name}_m WHERE t >= {2 * n}),
{name}_a AS (SELECT *, atan(abs(t_stat) / sqrt(dof)) AS angle FROM {name}_t),
{name}_l AS (SELECT *, least(pi() / 2 - angle, {DEVIATIONS} / sqrt(dof)) AS length FROM {name}_a),
{name} AS (SELECT ticker, t, t_stat, dof, CASE WHEN va = 0 AND vb = 0 THEN CASE WHEN ma <> mb THEN 0.0 END ELSE {p_value('dof')} END AS p FROM {name}_l)"""


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.simple_returns(market.panel(spark, sf_dir))


@query(with_(PANEL, RETURNS, z_cte("z60", 60)) + "SELECT ticker, t, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(z, 6) AS z FROM z60")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detectors.zscores(_returns(spark, sf_dir), 60).select("ticker", "t", "mu", "sigma", "z"))


JUMPS = z_cte("jz", JUMP[0]) + f", jc AS (SELECT ticker, t FROM jz WHERE abs(z) > {JUMP[1]})"


@query(with_(PANEL, RETURNS, JUMPS) + "SELECT ticker, t FROM jc")
def jump_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.jump_candidates(_returns(spark, sf_dir), *JUMP[:2])


JUMP_CTE = JUMPS + "," + cooled_cte("jump", "jc", JUMP[2])
WELCH = welch_cte("welch", TTEST[0])
TTEST_CTE = WELCH + f", tc AS (SELECT ticker, t FROM welch WHERE p < {TTEST[1]})," + cooled_cte("ttest", "tc", TTEST[2])
CUSUM_CTE = cusum_cte("cusum", *CUSUM)


@query(with_(PANEL, RETURNS, JUMP_CTE) + "SELECT ticker, t FROM jump")
def detect_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect_jump(_returns(spark, sf_dir), *JUMP)


@query(with_(PANEL, RETURNS, WELCH) + "SELECT ticker, t, round(t_stat, 6) AS t_stat, round(dof, 6) AS dof, round(p, 6) AS p FROM welch")
def welch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(detectors.welch_stats(_returns(spark, sf_dir), TTEST[0]))


OFTEN = with_(PANEL, RETURNS, WELCH, "tc AS (SELECT ticker, t FROM welch WHERE p < 0.3)", cooled_cte("ttest", "tc", TTEST[2])) + "SELECT ticker, t FROM ttest"


@query(OFTEN)
def detect_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a level at which these random prices have many detections."""
    return detectors.detect_ttest(_returns(spark, sf_dir), TTEST[0], 0.3, TTEST[2])


@query(OFTEN)
def detect_ttest_often(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name that the level had for a time."""
    return detect_ttest(spark, sf_dir)


@query(with_(PANEL, RETURNS, CUSUM_CTE) + "SELECT ticker, t FROM cusum")
def detect_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect_cusum(_returns(spark, sf_dir), *CUSUM)


@query(with_(PANEL, RETURNS, JUMP_CTE) + "SELECT ticker, t FROM jump")
def detect_jump_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same detections by following pointers, for series of any length."""
    return blocks.cooled(detectors.jump_candidates(_returns(spark, sf_dir), *JUMP[:2]), JUMP[2])


@query(with_(PANEL, RETURNS, CUSUM_CTE) + "SELECT ticker, t FROM cusum")
def detect_cusum_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same detections block by block, for series of any length."""
    return blocks.detect_cusum(_returns(spark, sf_dir), *CUSUM, rows=256)


BAYES = """
bz AS (SELECT ticker, t, z, row_number() OVER (PARTITION BY ticker ORDER BY t) AS k FROM z60 WHERE z IS NOT NULL),
bs AS (
  SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS k, CAST(0 AS INTEGER) AS t, [{'n': CAST(0 AS INTEGER), 's': CAST(0 AS DOUBLE), 'mass': CAST(1 AS DOUBLE)}] AS runs, CAST(0 AS INTEGER) AS before, CAST(0 AS INTEGER) AS best FROM bz
  UNION ALL
  SELECT ticker, k, t, runs, before, list_max(list_transform(runs, lambda r: {'mass': r.mass, 'n': r.n})).n AS best FROM (
    SELECT ticker, k, t, before, list_concat([{'n': CAST(0 AS INTEGER), 's': CAST(0 AS DOUBLE), 'mass': CAST(1 AS DOUBLE) / 250}],
        list_filter(list_transform(w, lambda r: {'n': CAST(r.n + 1 AS INTEGER), 's': r.s + z, 'mass': coalesce(r.mass / nullif(total, 0), 0) * (1 - CAST(1 AS DOUBLE) / 250)}), lambda r: r.mass >= 1e-3)) AS runs
    FROM (SELECT *, list_sum(list_transform(w, lambda r: r.mass)) AS total FROM (
      SELECT b.ticker, y.k, y.t, y.z, b.best AS before, list_transform(b.runs, lambda r: {'n': r.n, 's': r.s,
          'mass': r.mass * exp(-pow(y.z - r.s / (0.25 + r.n), 2) / (2 * (1 + 1 / (0.25 + r.n)))) / sqrt(1 + 1 / (0.25 + r.n))}) AS w
      FROM bs b JOIN bz y ON b.ticker = y.ticker AND y.k = b.k + 1) c) d) e)"""


@query(with_(PANEL, RETURNS, z_cte("z60", 60), BAYES) + "SELECT ticker, t, CAST(t - best + 1 AS INTEGER) AS began FROM bs WHERE best < before")
def detect_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the z-scores' mean, by the posterior of run lengths."""
    return online.detect_bayes(detectors.zscores(_returns(spark, sf_dir), 60))


EVENTS = f"""
pos AS (SELECT ticker, date, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM panel {WIN}),
near AS (SELECT ticker, event, min_by(pos, abs(date_diff('day', CAST(event_date AS DATE), date)) * 1000000 + pos) AS pos, any_value(n) AS n
  FROM pos JOIN {values(market.EVENTS, 'event, event_date')} ON abs(date_diff('day', CAST(event_date AS DATE), date)) <= 7 GROUP BY 1, 2),
cps AS (SELECT DISTINCT ticker, CAST(least(pos, n - 2) AS INTEGER) AS t FROM near WHERE n > 1)"""


@query(with_(PANEL, EVENTS) + "SELECT ticker, t FROM cps")
def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.match_events(market.panel(spark, sf_dir), market.events(spark))


EVALUATED = f"""
det AS (SELECT ticker, 'cusum' AS method, t FROM cusum UNION ALL SELECT ticker, 'jump', t FROM jump UNION ALL SELECT ticker, 'ttest', t FROM ttest),
spine AS (SELECT DISTINCT ticker, method FROM cps, (VALUES ('cusum'), ('jump'), ('ttest')) AS m(method)),
first_cp AS (SELECT d.ticker, d.method, d.t, min(c.t) AS cp FROM det d LEFT JOIN cps c ON d.ticker = c.ticker AND abs(d.t - c.t) <= {TOLERANCE} GROUP BY 1, 2, 3),
best AS (SELECT ticker, method, cp, min_by(t, abs(t - cp) * 1000000 + t) AS t FROM first_cp WHERE cp IS NOT NULL GROUP BY 1, 2, 3),
per AS (SELECT ticker, method, count(*) AS n_matched, avg(t - cp) AS mean_delay, string_agg(CAST(t - cp AS VARCHAR), ',' ORDER BY cp) AS delays FROM best GROUP BY 1, 2),
cnt AS (SELECT ticker, method, count(*) AS n_det, count(cp) AS n_tp FROM first_cp GROUP BY 1, 2),
ncp AS (SELECT ticker, count(*) AS n_cps FROM cps GROUP BY 1),
ev AS (SELECT s.ticker, s.method, coalesce(n_det, 0) AS n_det, coalesce(n_tp, 0) AS n_tp, coalesce(n_det, 0) - coalesce(n_tp, 0) AS n_fp,
  CASE WHEN coalesce(n_det, 0) = 0 THEN 0.0 ELSE (n_det - n_tp) / n_det END AS fpr,
  CASE WHEN coalesce(n_det, 0) = 0 THEN 0.0 WHEN coalesce(n_cps, 0) = 0 THEN 1.0 ELSE coalesce(n_matched, 0) / n_cps END AS recall, mean_delay, coalesce(delays, '') AS delays
  FROM spine s LEFT JOIN cnt USING (ticker, method) LEFT JOIN per USING (ticker, method) LEFT JOIN ncp USING (ticker))"""
ALL = (PANEL, RETURNS, CUSUM_CTE, JUMP_CTE, TTEST_CTE, EVENTS, EVALUATED)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all methods against the events, in one pass over the panel."""
    methods = comparison.Detectors(CUSUM, JUMP, TTEST)
    return comparison.compared(market.panel(spark, sf_dir), market.events(spark), methods, TOLERANCE)


@query(with_(*ALL) + "SELECT ticker, method, n_det, n_tp, n_fp, round(fpr, 6) AS fpr, round(recall, 6) AS recall, round(mean_delay, 6) AS mean_delay, delays FROM ev")
def evaluate_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delays as text."""
    return r6(_evaluated(spark, sf_dir).withColumn("delays", F.array_join(F.transform("delays", lambda d: d.cast("string")), ",")))


@query(with_(*ALL) + "SELECT ticker, method, n_det, n_tp, n_fp, round(fpr, 6) AS fpr, round(recall, 6) AS recall, round(mean_delay, 6) AS mean_delay, delays FROM ev")
def evaluate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from separate tables of detections and events, as they may come from anywhere."""
    panel = market.panel(spark, sf_dir)
    returns = detectors.simple_returns(panel)
    found = detectors.labelled(cusum=detectors.detect_cusum(returns, *CUSUM), jump=detectors.detect_jump(returns, *JUMP), ttest=detectors.detect_ttest(returns, *TTEST))
    cps = events.match_events(panel, market.events(spark))
    made = events.evaluate(found, cps, events.spine_of(cps, METHODS), TOLERANCE)
    return r6(made.withColumn("delays", F.array_join(F.transform("delays", lambda d: d.cast("string")), ",")))


@query(
    with_(*ALL)
    + "SELECT method, round(avg(fpr), 6) AS mean_fpr, round(stddev_pop(fpr), 6) AS std_fpr, round(avg(recall), 6) AS mean_recall, round(stddev_pop(recall), 6) AS std_recall, round(avg(mean_delay), 6) AS mean_delay, count(*) AS n_tickers FROM ev GROUP BY 1"
)
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(events.method_summary(_evaluated(spark, sf_dir)))


@query(
    with_(*ALL)
    + "SELECT ticker, "
    + ", ".join(f"round(max(CASE WHEN method = '{m}' THEN {c} END), 6) AS {m}_{c}" for m in METHODS for c in ("fpr", "recall"))
    + " FROM ev GROUP BY 1"
)
def method_detail_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(events.detail(_evaluated(spark, sf_dir), METHODS))


@query(with_(*ALL) + "SELECT ticker, method, n_det AS detections, format('{:.1f}%', fpr * 100) AS fpr, format('{:.1f}%', recall * 100) AS recall, coalesce(format('{:+.1f}', mean_delay), '-') AS mean_delay FROM ev")
def single_ticker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's own summary, as text."""
    return events.formatted(_evaluated(spark, sf_dir))


@query(with_(PANEL, RETURNS, z_cte("z60", 60)) + "SELECT ticker, t, round(z, 6) AS z FROM z60 WHERE z IS NOT NULL ORDER BY abs(round(z, 6)) DESC, ticker, t LIMIT 5")
def topk_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = r6(detectors.told(detectors.zscores(_returns(spark, sf_dir), 60), F.col("z").isNotNull(), "t", "z"))
    return z.orderBy(F.desc(F.abs("z")), "ticker", "t").limit(5)


@query(with_(PANEL) + "SELECT date, ticker, price FROM panel WHERE (year(date), ticker) IN (SELECT (year(date), ticker) FROM panel GROUP BY year(date), ticker HAVING count(*) >= 80)")
def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = market.panel(spark, sf_dir)
    listed = panel.groupBy(F.year("date").alias("year"), "ticker").agg(F.count("*").alias("n")).where("n >= 80")
    return r6(shapes.in_universe(panel, listed))


@query(
    with_(PANEL, RETURNS, "x AS (SELECT ticker, t, max(date) OVER f AS last_date, list(r) OVER f AS w FROM ret WINDOW f AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))")
    + "SELECT ticker, t, last_date, CAST(len(w) AS INTEGER) AS n, array_to_string(list_transform(w, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',') AS micros FROM x WHERE t >= 21 AND (t - 21) % 5 = 0"
)
def cpd_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returns of each window, in millionths, as text."""
    made = gaussian.cpd_windows(_returns(spark, sf_dir), 21, 5)
    micros = F.array_join(F.transform("window", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return made.select("ticker", "t", "last_date", F.size("window").alias("n"), micros.alias("micros"))


@query(
    with_(PANEL, RETURNS, WELCH)
    + f"""SELECT ticker, count(*) AS n_windows, round(avg(round(1 - p, 6)), 6) AS mean_nu, count(*) FILTER (round(1 - p, 6) > 0.9) AS n_hot,
  coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (round(1 - p, 6) > 0.9), '') AS hot_dates,
  coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 5 AND p IS NOT NULL), '') AS highest
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(1 - p, 6) DESC NULLS LAST, date) AS rank FROM welch JOIN ret USING (ticker, t) WHERE (t - {2 * TTEST[0]}) % 5 = 0) GROUP BY ticker"""
)
def rolled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rolled along each ticker, every fifth day, and what stands out: the number of windows, their mean score, the
    days with one over 0.9, and the days of the five highest. The score is one less the p of Welch's test."""
    tested = detectors.welch_stats(_returns(spark, sf_dir), TTEST[0], ("date",)).where((F.col("t") - 2 * TTEST[0]) % 5 == 0)
    scores = tested.withColumnRenamed("date", "last_date").withColumn("nu", F.round(1 - F.col("p"), 6))
    dates = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    made = gaussian.rolled(scores)
    return r6(made.select("ticker", "n_windows", "mean_nu", "n_hot", dates("hot_dates").alias("hot_dates"), dates(F.transform("highest", lambda x: x["last_date"])).alias("highest")))


def ewm_sql(name: str, source: str, column: str, alpha: str) -> str:
    """Moments with explicit weights (1 - alpha) ** age, over all rows before."""
    return f"""{name} AS (SELECT a.ticker, a.t, sum(b.{column} * pow(1 - {alpha}, a.t - b.t)) / sum(pow(1 - {alpha}, a.t - b.t)) AS mean,
  sum(pow(1 - {alpha}, a.t - b.t)) AS w, sum(pow(1 - {alpha}, 2 * (a.t - b.t))) AS w2, sum(b.{column} * b.{column} * pow(1 - {alpha}, a.t - b.t)) AS xx, count(*) AS n
  FROM {source} a JOIN {source} b ON a.ticker = b.ticker AND b.t <= a.t WHERE b.{column} IS NOT NULL GROUP BY 1, 2)"""


EWM_VOL = ewm_sql("e", "ret", "r", "(2.0 / 61)") + ", ewm AS (SELECT ticker, t, CASE WHEN n >= 2 THEN sqrt(greatest(0, xx / w - mean * mean) * w * w / (w * w - w2)) END AS vol FROM e)"


@query(with_(PANEL, RETURNS, EWM_VOL) + "SELECT ticker, t, round(vol, 6) AS vol FROM ewm")
def ewm_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(momentum.ewm_vol(_returns(spark, sf_dir)))


@query(with_(PANEL, RETURNS, EWM_VOL) + "SELECT ticker, t, round(r * 0.15 / nullif(lag(vol) OVER (PARTITION BY ticker ORDER BY t) * sqrt(252.0), 0), 6) + 0.0 AS scaled FROM ret JOIN ewm USING (ticker, t)")
def vol_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(momentum.vol_scaled(_returns(spark, sf_dir)))


PLACED = f"placed AS (SELECT ticker, CAST(row_number() OVER w - 1 AS INTEGER) AS t, date, price FROM panel {WIN})"
NORMED = ", ".join(f"round((price / nullif(lag(price, {k}) OVER w, 0) - 1) / nullif(vol * sqrt({float(k)}), 0), 6) + 0.0 AS norm_{k}" for k in momentum.NORM_HORIZONS)


@query(with_(PANEL, RETURNS, EWM_VOL, PLACED) + f"SELECT p.ticker, p.t, {NORMED} FROM placed p LEFT JOIN ewm e ON e.ticker = p.ticker AND e.t = p.t - 1 WINDOW w AS (PARTITION BY p.ticker ORDER BY p.t)")
def normalised_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(momentum.normalised_returns(market.panel(spark, sf_dir)))


def _macd_ctes() -> tuple[str, ...]:
    scales = sorted({s for pair in momentum.MACD_PAIRS for s in pair})
    full = lambda c, n: f"CASE WHEN count({c}) OVER (PARTITION BY ticker ORDER BY t ROWS {n - 1} PRECEDING) = {n} THEN stddev_samp({c}) OVER (PARTITION BY ticker ORDER BY t ROWS {n - 1} PRECEDING) END"
    means = [ewm_sql(f"m{s}", "placed", "price", f"(1.0 / {s})") for s in scales]
    joined = " ".join(f"JOIN m{s} USING (ticker, t)" for s in scales)
    q = ", ".join(f"(m{a}.mean - m{b}.mean) / nullif(sd, 0) AS q_{a}_{b}" for a, b in momentum.MACD_PAIRS)
    out = ", ".join(f"q_{a}_{b} / nullif({full(f'q_{a}_{b}', 252)}, 0) AS macd_{a}_{b}" for a, b in momentum.MACD_PAIRS)
    return (PLACED, *means, f"spread AS (SELECT *, {full('price', 63)} AS sd FROM placed)", f"q AS (SELECT ticker, t, {q} FROM spread {joined})", f"macd AS (SELECT ticker, t, {out} FROM q)")


@query(with_(PANEL, *_macd_ctes()) + "SELECT ticker, t, " + ", ".join(f"round(macd_{a}_{b}, 6) AS macd_{a}_{b}" for a, b in momentum.MACD_PAIRS) + " FROM macd")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(momentum.macd(market.panel(spark, sf_dir)))


@query(
    with_(PANEL, *_macd_ctes())
    + "SELECT ticker, t, round(("
    + " + ".join(f"macd_{a}_{b} * exp(-macd_{a}_{b} * macd_{a}_{b} / 4) / 0.89" for a, b in momentum.MACD_PAIRS)
    + ") / 3, 6) AS position FROM macd"
)
def macd_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(momentum.macd_position(momentum.macd(market.panel(spark, sf_dir))))


@query(with_(PANEL, PLACED) + "SELECT ticker, t, CAST(1.0 AS DOUBLE) AS position FROM placed")
def long_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum.long_only(market.panel(spark, sf_dir))


def _sign(n: int) -> str:
    return f"sign({lagged('arith', n)})"


def _tsmom(weight: float, name: str) -> str:
    return f"CAST({1 - weight} * {_sign(252)} + {weight} * {_sign(21)} AS DOUBLE) AS {name}"


@query(with_(PANEL) + f"SELECT ticker, CAST(row_number() OVER w - 1 AS INTEGER) AS t, {_tsmom(0.5, 'position')} FROM panel {WIN}")
def tsmom_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum.tsmom_position(market.panel(spark, sf_dir))


for _weight in (0.0, 1.0):

    def _tsmom_at(spark: SparkSession, sf_dir: str, weight: float = _weight) -> DataFrame:
        return momentum.tsmom_position(market.panel(spark, sf_dir), weight)

    _tsmom_at.__name__ = f"tsmom_position_{'slow' if _weight == 0 else 'fast'}"
    query(with_(PANEL) + f"SELECT ticker, CAST(row_number() OVER w - 1 AS INTEGER) AS t, {_tsmom(_weight, 'position')} FROM panel {WIN}")(_tsmom_at)


@query(
    with_(PANEL, RETURNS, f"pos AS (SELECT ticker, row_number() OVER w - 1 AS t, {_tsmom(0.5, 'position')} FROM panel {WIN})", "x AS (SELECT position * r AS x FROM pos JOIN ret USING (ticker, t))")
    + "SELECT round(-sqrt(252.0) * avg(x) / stddev_pop(x), 6) AS loss FROM x"
)
def sharpe_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(momentum.sharpe_loss(momentum.tsmom_position(market.panel(spark, sf_dir)), _returns(spark, sf_dir)))


@query(
    with_(
        CALM, RETURNS,
        "lv AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker ORDER BY t ROWS UNBOUNDED PRECEDING) AS level FROM ret WHERE r IS NOT NULL)",
        "ld AS (SELECT *, level / greatest(1.0, max(level) OVER (PARTITION BY ticker ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1 AS d FROM lv)",
        """s AS (SELECT ticker, pow(1 + avg(r), 252) - 1 AS y, stddev_samp(r) * sqrt(252.0) AS v, sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(*)) * sqrt(252.0) AS dn, min(d) AS dd,
           avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN r > 0 THEN r END) AS g, avg(CASE WHEN r < 0 THEN r END) AS l FROM ld GROUP BY 1)""",
    )
    + "SELECT ticker, round(y, 5) AS ann_return, round(v, 6) AS ann_vol, round(y / v, 5) AS sharpe, round(y / dn, 5) AS sortino, round(dd, 6) AS max_drawdown, round(y / -dd, 5) AS calmar, round(hit, 6) AS hit_ratio, round(g / -l, 6) AS profit_loss FROM s"
)
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = momentum.portfolio_metrics(detectors.simple_returns(market.calm(spark, sf_dir)))
    coarse = ("ann_return", "sharpe", "sortino", "calmar")  # powers of 252 magnify the last bits
    return made.select(*[F.round(c, 5 if c in coarse else 6).alias(c) if c != "ticker" else c for c in made.columns])


FOLDS = "f(fold, s, e) AS (VALUES (0, DATE '1997-01-01', DATE '1999-01-01'), (1, DATE '1999-01-01', DATE '2001-01-01'), (2, DATE '2001-01-01', DATE '2002-01-01'))"


@query(
    with_(PANEL, RETURNS, FOLDS, "tr AS (SELECT fold, ticker, CASE WHEN avg(r) >= 0 THEN 1.0 ELSE -1.0 END AS side FROM ret JOIN f ON date < s AND date >= DATE '1995-01-01' GROUP BY 1, 2)")
    + "SELECT CAST(fold AS INTEGER) AS fold, ticker, date, CAST(side AS DOUBLE) AS position, round(r, 6) AS r FROM ret JOIN f ON date >= s AND date < e JOIN tr USING (fold, ticker)"
)
def expanding_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign of the mean training return, held throughout a fold."""
    folds = backtest.folds(spark, 1995, 1997, 2002, 2)
    return r6(backtest.expanding_positions(_returns(spark, sf_dir).select("ticker", "date", "r"), backtest.mean_sign(), folds))


LAGGED = "feat AS (SELECT *, lag(r) OVER (PARTITION BY ticker ORDER BY t) AS x FROM ret)"


@query(
    with_(
        PANEL, RETURNS, LAGGED, FOLDS,
        "tr AS (SELECT fold, regr_slope(r, x) AS slope, regr_intercept(r, x) AS level FROM feat JOIN f ON date < s AND date >= DATE '1995-01-01' WHERE x IS NOT NULL AND r IS NOT NULL GROUP BY 1)",
    )
    + "SELECT CAST(fold AS INTEGER) AS fold, ticker, date, CAST(coalesce(sign(slope * x + level), 0) AS DOUBLE) AS position, round(r, 6) AS r FROM feat JOIN f ON date >= s AND date < e JOIN tr USING (fold)"
)
def expanding_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One least-squares line for all tickers: today's return by yesterday's."""
    data = _returns(spark, sf_dir).withColumn("x", F.lag("r").over(Window.partitionBy("ticker").orderBy("t"))).select("ticker", "date", "r", "x")
    made = backtest.expanding_positions(data, backtest.regression("x"), backtest.folds(spark, 1995, 1997, 2002, 2), ())
    return r6(made.drop("x"))


@query(
    with_(
        PANEL, RETURNS, LAGGED,
        "p AS (SELECT r, x, tanh(0.1 + 0.5 * coalesce(x, 0)) AS p FROM feat WHERE r IS NOT NULL)",
        "z AS (SELECT p * r AS z, r * (1 - p * p) AS d0, r * (1 - p * p) * coalesce(x, 0) AS d1 FROM p)",
        "m AS (SELECT avg(z) AS m, stddev_pop(z) AS s, avg(d0) AS d0, avg(d1) AS d1, avg(z * d0) AS zd0, avg(z * d1) AS zd1 FROM z)",
    )
    + "SELECT round(-sqrt(252.0) * m / s, 6) AS loss, round(-sqrt(252.0) * (d0 / s - m * (zd0 - m * d0) / pow(s, 3)), 6) AS g0, round(-sqrt(252.0) * (d1 / s - m * (zd1 - m * d1) / pow(s, 3)), 6) AS g1 FROM m"
)
def sharpe_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of a position model with given weights on yesterday's return, and its gradient."""
    data = _returns(spark, sf_dir).withColumn("x", F.lag("r").over(Window.partitionBy("ticker").orderBy("t")))
    return r6(training.loss_and_gradient(training.gradient_sums(data, ("x",), (0.0,), (1.0,), (0.1, 0.5)), 2))
