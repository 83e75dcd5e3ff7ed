"""How complete a panel is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.stats import clipped


def coverage(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker").agg(F.count("date").alias("n_obs")).orderBy("n_obs", "ticker")


def alive_fraction(panel: DataFrame) -> DataFrame:
    """Share of all tickers that have a row on each date."""
    everything = panel.agg(F.countDistinct("ticker").alias("n"))
    daily = panel.groupBy("date").agg(F.countDistinct("ticker").alias("alive"))
    return daily.crossJoin(F.broadcast(everything)).select("date", (F.col("alive") / F.col("n")).alias("fraction"))  # one row


def coverage_summary(panel: DataFrame) -> DataFrame:
    dates = panel.agg(F.countDistinct("date").alias("n_dates"))
    each = coverage(panel).crossJoin(F.broadcast(dates))  # one row
    return each.agg(
        F.min("n_obs").alias("min_obs"), F.floor(F.median("n_obs")).alias("median_obs"), F.max("n_obs").alias("max_obs"),
        F.count_if(F.col("n_obs") == F.col("n_dates")).alias("full_history"), F.count("*").alias("n_tickers"), F.max("n_dates").alias("n_dates"),
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def nan_fraction(panel: DataFrame) -> DataFrame:
    """Share of the dense date by ticker matrix that has no price."""
    n = panel.agg(F.count("price").alias("n"), F.countDistinct("date").alias("d"), F.countDistinct("ticker").alias("t"))
    return n.select((1 - F.try_divide(F.col("n"), F.col("d") * F.col("t"))).alias("nan_fraction"))


def tickers_by(panel: DataFrame, column: str) -> DataFrame:
    """Distinct tickers for each non-null value, most first."""
    return panel.where(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct("ticker").alias("n_tickers")).orderBy(F.desc("n_tickers"), column)


def histogram(values: DataFrame, column: str, low: float = -0.2, high: float = 0.2, bins: int = 200) -> DataFrame:
    """(bin, count) over equal bins between the least and greatest clipped value; the last bin has its right edge."""
    x = values.select(clipped(F.col(column), low, high).alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.floor((F.col("x") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    bin_ = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return x.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))  # one row
