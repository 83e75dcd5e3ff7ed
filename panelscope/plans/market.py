"""A price panel, its benchmark and its events from the order tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Exchange suffixes; the last six have no country (fixed values).
SUFFIXES = ("LN", "FP", "GY", "NA", "IM", "SQ", "SE", "SS", "DC", "FH", "NO", "BB", "AV", "PL", "ID", "PW", "SW", "GA", "SM", "VX", "IR", "CK")
LEVEL = 100_000.0
#: Items that a task is dealt, about: some hundred MB with all that windows add to them.
ITEMS = 200_000
#: The tickers that are looked at closely, without their suffixes.
ANALYSED = tuple(f"S{k}" for k in range(1, 9))
#: Events inside the calendar of the order tables: two close together, one on a weekend, one far outside.
EVENTS = (
    ("outside", "1990-01-02"), ("first", "1995-09-12"), ("second", "1996-03-05"), ("close", "1996-03-15"), ("weekend", "1997-06-14"),
    ("third", "1998-01-20"), ("fourth", "1998-10-08"), ("fifth", "1999-07-01"), ("sixth", "2000-04-14"), ("last", "2001-02-20"),
)


def _price() -> Column:
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return exact("l_extendedprice") / exact("l_quantity")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, price): the mean price by supplier and shipping day. Sums are exact in any order. Rows are dealt by
    ticker once, for the sums and for all windows after them; conditions on tickers reach the suppliers before the join."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), F.col("s_nationkey") % len(SUFFIXES) + 1)
    names = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(" "), suffix).alias("ticker"))
    return _dealt(items.join(names, "l_suppkey"), items).groupBy("date", "ticker").agg(_price().alias("price"))


def _dealt(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows by ticker. Tables of over ITEMS rows for each core are dealt to so many more tasks that none of them takes more,
    on average, as sorts and windows keep a task's rows in memory."""
    tasks = -(-items.count() // ITEMS)
    return rows.repartition(tasks, "ticker") if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition("ticker")


def calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with prices raised by a constant: its returns are small, so that indices stay within the digits of a double."""
    return panel(spark, sf_dir).withColumn("price", F.col("price") + LEVEL)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, price): the mean price of all, raised like the calm panel's, as yearly rates are daily ones to the power 252."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    return items.groupBy("date").agg((_price() + LEVEL).alias("price"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide matrix of fixed width: the mean price by date, one column for each exchange suffix, null where none shipped."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % len(SUFFIXES)).alias("k"))
    of = lambda c, k: F.sum(F.when(F.col("k") == k, F.col(c).cast("decimal(18,2)"))).cast("double")
    return items.join(suppliers, "l_suppkey").groupBy("date").agg(*[F.try_divide(of("l_extendedprice", k), of("l_quantity", k)).alias(f"ALL {s}") for k, s in enumerate(SUFFIXES)])


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS, "event string, event_date string").withColumn("event_date", F.col("event_date").cast("date"))
