"""Returns and realised volatility by ticker. Lags count a ticker's rows, not days.

All windows share one partitioning and order, so a plan has one exchange and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import ratio_return
from panelscope.operators import rolling
from panelscope.schema import HORIZONS, TRADING_DAYS, VOL_WINDOWS

def _by_date() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def log_return(rows: int) -> Column:
    """Null for prices that aren't positive."""
    return F.ln("price") - F.lag(F.ln("price"), rows).over(_by_date())


def arith_return(rows: int) -> Column:
    return ratio_return(F.col("price"), F.lag("price", rows).over(_by_date()))


def add_log_returns(panel: DataFrame, horizons: tuple = HORIZONS) -> DataFrame:
    return panel.withColumns({f"{name}_log_ret": log_return(n) for n, name in horizons})


def add_arith_returns(panel: DataFrame, horizons: tuple = HORIZONS) -> DataFrame:
    return panel.withColumns({f"{name}_arith_ret": arith_return(n) for n, name in horizons})


def add_realized_vol(panel: DataFrame, windows: tuple = VOL_WINDOWS, annualization: int = TRADING_DAYS) -> DataFrame:
    """Sample deviation of the last w daily log returns, per year; null until there are w of them."""
    run = rolling.with_running(panel.withColumn("_daily", log_return(1)), "_daily", "ticker", "date")
    known = rolling.with_moments(run, {f"_{name}": (w - 1, 0) for w, name in windows}, "ticker", "date")
    vol = {f"{name}_vol": rolling.full_deviation(f"_{name}", w) * math.sqrt(annualization) for w, name in windows}
    return known.select(*[f"`{c}`" for c in panel.columns], *[v.alias(name) for name, v in vol.items()])


def add_features(panel: DataFrame, horizons: tuple = HORIZONS, windows: tuple = VOL_WINDOWS, annualization: int = TRADING_DAYS) -> DataFrame:
    returns = {f"{name}_log_ret": log_return(n) for n, name in horizons} | {f"{name}_arith_ret": arith_return(n) for n, name in horizons}
    return add_realized_vol(panel.withColumns(returns), windows, annualization)
