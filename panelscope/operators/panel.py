"""Shape and dimensions of the long panel (date, ticker, price)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.stats import clean, exchange_of
from panelscope.schema import COUNTRY_REGION, EXCHANGE_COUNTRY, FEATURE_COLUMNS


def wide_to_long(wide: DataFrame) -> DataFrame:
    """One row for each price that is neither null nor NaN. A sort is left to whoever needs one. The columns become one array,
    which one generator takes apart beside the array of their names, so that a plan has as many operators for a thousand
    columns as for two."""
    tickers = [c for c in wide.columns if c != "date"]
    if not tickers:
        return wide.select("date", F.lit("").alias("ticker"), F.lit(0.0).alias("price")).limit(0)
    prices = F.array(*[F.col(f"`{c.replace('`', '``')}`").cast("double") for c in tickers])
    each = wide.select("date", F.posexplode(prices).alias("_at", "price")).where("price is not null and not isnan(price)")
    return each.select("date", F.lit(tickers)[F.col("_at")].alias("ticker"), "price")


def long_to_wide(long: DataFrame, key: str, names: list[str], value: str = "price") -> DataFrame:
    """One column for each of the given names, which saves the job that would look for them."""
    return long.groupBy("date").pivot(key, names).agg(F.first(value, ignorenulls=True))


def dimensions(panel: DataFrame) -> DataFrame:
    """(exchange, country, region): sixteen rows."""
    spark = panel.sparkSession
    country = spark.createDataFrame(EXCHANGE_COUNTRY, "exchange string, country string")
    region = spark.createDataFrame(COUNTRY_REGION, "country string, region string")
    return country.join(F.broadcast(region), "country", "left").select("exchange", "country", "region")


def add_country_region(panel: DataFrame) -> DataFrame:
    """exchange, country and region by the ticker's suffix; null country and region where it isn't mapped."""
    return panel.withColumn("exchange", exchange_of(F.col("ticker"))).join(F.broadcast(dimensions(panel)), "exchange", "left").select(*panel.columns, "exchange", "country", "region")


def finalize(panel: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """The given columns that the panel has, in the given order, by date and ticker."""
    return panel.select(*[f"`{c}`" for c in columns if c in panel.columns]).orderBy("date", "ticker")


def normalised(panel: DataFrame) -> DataFrame:
    """NaN prices as null, then gone."""
    return panel.withColumn("price", clean(F.col("price"))).where("price is not null")


def in_universe(panel: DataFrame, by_year: DataFrame) -> DataFrame:
    """Rows whose ticker is listed for the year of the date."""
    listed = by_year.select(F.col("year").alias("_year"), "ticker").distinct()
    return panel.withColumn("_year", F.year("date")).join(listed, ["_year", "ticker"], "left_semi").drop("_year").select(*panel.columns)
