"""Volatility scaling, momentum signals and portfolio metrics."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import ratio_return
from panelscope.operators import rolling
from panelscope.operators.scan import Moment, ewm
from panelscope.schema import TRADING_DAYS


def _by_t() -> Window:
    return Window.partitionBy("ticker").orderBy("t")


#: Rows of price history that the model features look back (fixed values).
NORM_HORIZONS = (1, 21, 63, 126, 252)
MACD_PAIRS = ((8, 24), (16, 28), (32, 96))


def _span(span: float) -> float:
    return 1 - 2 / (span + 1)


def ewm_vol(returns: DataFrame, span: int = 60) -> DataFrame:
    """(ticker, t, vol): exponentially weighted deviation of daily returns."""
    return ewm(returns.select("ticker", "t", "r"), {"vol": Moment("r", "sd", _span(span))}).select("ticker", "t", "vol")


def vol_scaled(returns: DataFrame, target: float = 0.15, span: int = 60) -> DataFrame:
    """(ticker, t, scaled): r * target over the day before's yearly volatility."""
    known = ewm(returns.select("ticker", "t", "r"), {"vol": Moment("r", "sd", _span(span))})
    before = F.lag("vol").over(_by_t()) * math.sqrt(TRADING_DAYS)
    return known.select("ticker", "t", (F.col("r") * F.try_divide(F.lit(target), before)).alias("scaled"))


def _placed(panel: DataFrame) -> DataFrame:
    """(ticker, t, price), t counting price rows from 0."""
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.select("ticker", (F.row_number().over(w) - 1).alias("t"), "price")


def normalised_returns(panel: DataFrame, horizons: tuple[int, ...] = NORM_HORIZONS, span: int = 60) -> DataFrame:
    """(ticker, t, norm_<k>): return over k rows by the daily volatility times the root of k. t counts price rows from 0."""
    back = {f"r_{k}": ratio_return(F.col("price"), F.lag("price", k).over(_by_t())) for k in {1, *horizons}}
    known = ewm(_placed(panel).withColumns(back).drop("price"), {"vol": Moment("r_1", "sd", _span(span))})
    return known.select("ticker", "t", *[F.try_divide(F.col(f"r_{k}"), F.col("vol") * math.sqrt(k)).alias(f"norm_{k}") for k in horizons])


def macd(panel: DataFrame, pairs: tuple[tuple[int, int], ...] = MACD_PAIRS, price_window: int = 63, signal_window: int = 252) -> DataFrame:
    """(ticker, t, macd_<short>_<long>): difference of two exponential means of the price, of time scales short and long,
    by the price's deviation and then by its own."""
    scales = sorted({s for pair in pairs for s in pair})
    known = ewm(_placed(panel), {f"mean_{s}": Moment("price", "mean", 1 - 1 / s) for s in scales})
    known = rolling.with_moments(rolling.with_running(known, "price", "ticker", "t"), {"price": (price_window - 1, 0)}, "ticker", "t")
    known = known.withColumn("deviation", rolling.full_deviation("price", price_window))
    known = known.select("ticker", "t", *[F.try_divide(F.col(f"mean_{a}") - F.col(f"mean_{b}"), F.col("deviation")).alias(f"q_{a}_{b}") for a, b in pairs])
    for a, b in pairs:
        q = f"q_{a}_{b}"
        known = rolling.with_moments(rolling.with_running(known, q, "ticker", "t", q), {q: (signal_window - 1, 0)}, "ticker", "t", q)
    return known.select("ticker", "t", *[F.try_divide(F.col(f"q_{a}_{b}"), rolling.full_deviation(f"q_{a}_{b}", signal_window)).alias(f"macd_{a}_{b}") for a, b in pairs])


def model_inputs(panel: DataFrame, pairs: tuple[tuple[int, int], ...] = MACD_PAIRS, horizons: tuple[int, ...] = NORM_HORIZONS, span: int = 60, target: float = 0.15) -> DataFrame:
    """(ticker, date, t, r, norm_<k> ..., macd_<short>_<long> ...): what is known after row t, and r, the next row's return scaled
    to the target volatility, which a position taken then gains; date is the next row's. A ticker's last row has none."""
    w = Window.partitionBy("ticker").orderBy("t")
    dated = panel.select("ticker", "date", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).alias("t"))
    after = ewm(_placed(panel).withColumn("r", ratio_return(F.col("price"), F.lag("price").over(w))), {"vol": Moment("r", "sd", _span(span))})
    gain = F.lead("r").over(w) * F.try_divide(F.lit(target), F.col("vol") * math.sqrt(TRADING_DAYS))
    gains = after.select("ticker", "t", gain.alias("r")).join(dated.select("ticker", (F.col("t") - 1).alias("t"), "date"), ["ticker", "t"])
    known = normalised_returns(panel, horizons, span).join(macd(panel, pairs), ["ticker", "t"])
    return gains.join(known, ["ticker", "t"]).select("ticker", "date", "t", "r", *[c for c in known.columns if c not in ("ticker", "t")])


def tsmom_position(panel: DataFrame, weight: float = 0.5, slow: int = 252, fast: int = 21) -> DataFrame:
    """(ticker, t, position): (1 - weight) * sign of the slow return + weight * sign of the fast one."""
    w = Window.partitionBy("ticker").orderBy("date")
    sign = lambda k: F.signum(ratio_return(F.col("price"), F.lag("price", k).over(w)))
    return panel.select("ticker", (F.row_number().over(w) - 1).alias("t"), ((1 - weight) * sign(slow) + weight * sign(fast)).alias("position"))


def macd_position(signals: DataFrame, pairs: tuple[tuple[int, int], ...] = MACD_PAIRS) -> DataFrame:
    """(ticker, t, position): the mean over the pairs of the response y * exp(-y**2 / 4) / 0.89 to a MACD signal; null
    where one is."""
    y = [F.col(f"macd_{a}_{b}") for a, b in pairs]
    return signals.select("ticker", "t", (reduce(operator.add, [x * F.exp(-x * x / 4) / 0.89 for x in y]) / len(y)).alias("position"))


def long_only(panel: DataFrame) -> DataFrame:
    """(ticker, t, position): always 1."""
    return _placed(panel).select("ticker", "t", F.lit(1.0).alias("position"))


def portfolio_metrics(returns: DataFrame, by: str = "ticker") -> DataFrame:
    """Per group: ann_return, ann_vol, sharpe, sortino, max_drawdown, calmar, hit_ratio and profit_loss of daily returns r
    in order of t. sharpe is the yearly return over the yearly deviation; sortino takes the root mean square of losses."""
    so_far = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    known = returns.where("r is not null").withColumn("level", F.product(1 + F.col("r")).over(so_far))
    known = known.withColumn("drawdown", F.try_divide(F.col("level"), F.greatest(F.lit(1.0), F.max("level").over(so_far))) - 1)
    loss = F.when(F.col("r") < 0, F.col("r"))
    stats = known.groupBy(by).agg(
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.sqrt(F.sum(F.coalesce(loss * loss, F.lit(0.0))) / F.count("*")).alias("down"),
        F.min("drawdown").alias("dd"), F.avg((F.col("r") > 0).cast("int")).alias("hit"), F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("gain"), F.avg(loss).alias("loss"),
    )
    year = F.pow(1 + F.col("mean"), TRADING_DAYS) - 1
    root = math.sqrt(TRADING_DAYS)
    return stats.select(
        by, year.alias("ann_return"), (F.col("sd") * root).alias("ann_vol"), F.try_divide(year, F.col("sd") * root).alias("sharpe"),
        F.try_divide(year, F.col("down") * root).alias("sortino"), F.col("dd").alias("max_drawdown"), F.try_divide(year, -F.col("dd")).alias("calmar"),
        F.col("hit").alias("hit_ratio"), F.try_divide(F.col("gain"), -F.col("loss")).alias("profit_loss"),
    )


def sharpe_loss(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """(loss): minus the yearly Sharpe ratio of position * r over all rows."""
    x = positions.join(returns, ["ticker", "t"]).select((F.col("position") * F.col("r")).alias("x"))
    return x.agg((-math.sqrt(TRADING_DAYS) * F.try_divide(F.avg("x"), F.stddev_pop("x"))).alias("loss"))
