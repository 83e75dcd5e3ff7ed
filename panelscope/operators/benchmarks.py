"""Equal-weight and given benchmarks: indices, stacking, rebasing and risk.

Windows over the calendar have no partition key; they run on one row for each date (and benchmark).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.stats import half_even, ratio_return
from panelscope.operators.features import arith_return
from panelscope.operators.panel import long_to_wide
from panelscope.schema import TRADING_DAYS

NAMES = ["SXXR", "EW"]


def _calendar() -> Window:
    return Window.orderBy("date")


def equal_weight_returns(panel: DataFrame, fill: str = "pad") -> DataFrame:
    """(date, ret): the mean over tickers of the daily return on the common calendar.

    pad: a ticker without a price keeps its last one, so it counts with a return of 0 from its second
    calendar date on, for ever. none: a return counts if the ticker had a price on the calendar's
    previous date. Neither needs the dense matrix.
    """
    if fill not in ("pad", "none"):
        raise ValueError(f"fill is pad or none, not {fill}")
    returns = panel.withColumn("r", arith_return(1))
    if fill == "none":
        calendar = panel.select("date").distinct().withColumn("day", F.row_number().over(_calendar()))
        placed = returns.join(calendar, "date")
        before = F.lag("day").over(Window.partitionBy("ticker").orderBy("date"))
        near = placed.withColumn("r", F.when(F.col("day") - before == 1, F.col("r")))
        return near.groupBy("date").agg(F.avg("r").alias("ret"))
    first = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) == 1
    daily = returns.withColumn("starts", first.cast("int")).groupBy("date").agg(F.sum("r").alias("total"), F.sum("starts").alias("starts"))
    begun = F.coalesce(F.sum("starts").over(_calendar().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return daily.withColumn("begun", begun).select("date", F.try_divide(F.coalesce("total", F.lit(0.0)), F.col("begun")).alias("ret"))


def index_of_returns(returns: DataFrame, base: float = 100.0) -> DataFrame:
    """(date, price): base times the cumulative product of 1 + ret, exactly base on the first date; a null ret is
    passed over and is null itself."""
    so_far = _calendar().rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.row_number().over(_calendar()) == 1, F.lit(base)).when(F.col("ret").isNotNull(), base * F.product(1 + F.col("ret")).over(so_far))
    return returns.select("date", level.alias("price"))


def equal_weight_index(panel: DataFrame, fill: str = "pad") -> DataFrame:
    return index_of_returns(equal_weight_returns(panel, fill))


def stacked(given: DataFrame, equal_weight: DataFrame) -> DataFrame:
    """(date, benchmark, price) of both, by date and benchmark."""
    parts = [df.select("date", F.lit(name).alias("benchmark"), "price") for name, df in zip(NAMES, (given, equal_weight))]
    return parts[0].unionByName(parts[1]).orderBy("date", "benchmark")


def side_by_side(stack: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """One column for each benchmark, on the dates that all have."""
    return long_to_wide(stack, "benchmark", names).na.drop("any")


def rebased(stack: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """Each benchmark is 100 on the first common date."""
    start = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return side_by_side(stack, names).select("date", *[(100 * F.try_divide(F.col(n), F.first(n).over(start))).alias(n) for n in names])


def rebased_first_valid(panel: DataFrame) -> DataFrame:
    """(date, ticker, price, level): level is 100 at the ticker's first price that isn't null; null prices are dropped."""
    whole = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = panel.where("price is not null")
    return held.withColumn("level", 100 * F.try_divide(F.col("price"), F.first("price", ignorenulls=True).over(whole)))


def drawdowns(stack: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """(date, benchmark, level, drawdown) on common dates, level rebased to 100."""
    long = rebased(stack, names).unpivot("date", names, "benchmark", "level")
    so_far = Window.partitionBy("benchmark").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("drawdown", ratio_return(F.col("level"), F.max("level").over(so_far)))


def risk_stats(stack: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """cagr_pct, vol_pct, sharpe and max_dd_pct of each benchmark, rounded half to even. Returns are taken after the
    join on common dates."""
    before = F.lag("level").over(Window.partitionBy("benchmark").orderBy("date"))
    daily = drawdowns(stack, names).withColumn("r", ratio_return(F.col("level"), before))
    stats = daily.groupBy("benchmark").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min("drawdown").alias("dd"))
    cagr, vol = F.pow(1 + F.col("mean"), TRADING_DAYS) - 1, F.col("sd") * math.sqrt(TRADING_DAYS)
    return stats.select(
        "benchmark", half_even(cagr * 100).alias("cagr_pct"), half_even(vol * 100).alias("vol_pct"),
        half_even(F.try_divide(cagr, vol)).alias("sharpe"), half_even(F.col("dd") * 100).alias("max_dd_pct"),
    )
